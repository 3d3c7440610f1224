"""All chosen methods in three passes over the travel-time pairs.

Every method divides by totals and sums weighted ratios, so each pass is "attach a per-key table,
then sum per key", whatever the number of methods:

1. per origin: the totals of decay and of capacity times decay (only for the three-step methods);
2. per destination: the demand of each method, from the origin's population and totals;
3. per origin: the score of each method, from the facility's ratios.

The share of a pair is its weight over the origin's total. In pass 3 that total is taken out of the
sum, so the pass needs the facility's ratios but nothing of the origin. Only where a decay is so narrow
that its square is no longer a double are the totals attached to the pairs as well. All sums have a map-side half,
hence no task ever holds all pairs of one origin or of one destination. With both small tables
broadcast the pairs are not shuffled at all; see ``operators.lookup`` for tables beyond that size. Where
neither can be broadcast, the pairs are dealt by facility, get its capacity there, and are dealt by
origin with it, so that the totals of pass 1 are summed where the pairs lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METHODS, Columns, Layout, Params, checked_methods, measure_layout
from ..functions import nan_safe_sum, positive_ratio, safe_ratio, weight
from ..operators.catchment import within_catchment
from ..operators.lookup import SLICE, Dealt, deal, hot_keys_together, sum_per_key
from ..operators.stored import StoredPairs, store_pairs
from ..operators.tables import people_table, supply_table

# Pass 3 multiplies two decays before it divides by the origin's total of decays. Up to this exponent
# the product of two smallest weights, exp(-600), is an ordinary double. Beyond it the pass divides first.
_LARGEST_EXPONENT = 300.0

# Stands for a missing destination; no facility has it as its key.
_NO_DESTINATION = "\0"
_NOT_A_KEY = "\0\0"


def accessibility(
    od: DataFrame | StoredPairs,
    origins: DataFrame,
    facilities: DataFrame,
    *,
    methods: Sequence[str] = METHODS,
    params: Params = Params(),
    cols: Columns = Columns(),
    layout: Layout | None = None,
    scale: float = 1.0,
    store: bool = False,
) -> DataFrame:
    """One row per origin: its public id and ``SPAI_<method>`` for each method, times ``scale``.

    The tables are those of ``sources``; ids must be unique (``operators.validate_*``). Without a
    ``layout`` the two small tables are measured first; tables too large to broadcast have the pairs
    searched for hot ids. The pairs are read up to three times and once per search: with ``store`` they are
    written once, narrow and filtered, and read from there, which pays for text files and costly queries.
    Pairs stored by origin (``operators.store_by_origin``) stay in their buckets.
    """
    methods = checked_methods(methods)
    layout = layout or measure_layout(origins, facilities, cols)
    narrow = params.decay == "gaussian" and (params.d0 / params.decay_f) ** 2 > _LARGEST_EXPONENT

    o, d = cols.origin, cols.destination
    bucketed = od if isinstance(od, StoredPairs) else None
    if bucketed is not None:
        near = bucketed.within(params)
    else:
        near = store_pairs(od, params, cols) if store else within_catchment(od, params, cols)
    # A destination that cannot be null spares every pass a null filter that would parse the name again.
    # Routes without an origin add to no score.
    pairs = near.filter(F.col(o).isNotNull()).select(
        o,
        F.coalesce(F.col(d), F.lit(_NO_DESTINATION)).alias(d),
        weight(F.col(cols.time), params).alias("_f"),
        *([SLICE] if bucketed is not None else []),
    )
    people = people_table(origins, cols)
    supply = supply_table(facilities, cols)
    # A facility of unknown capacity makes a total NaN, which no share is taken of.
    known = supply.withColumn("_supply", F.coalesce(F.col("_supply"), F.lit(float("nan"))))

    # A table too large to broadcast: deal the pairs out by its key once, for all passes.
    named = pairs.filter(F.col(d) != _NO_DESTINATION).drop(SLICE)
    searches = [] if layout.small_facilities else [(named, d)]
    if bucketed is None and not layout.small_origins:
        searches.append((pairs, o))
    hot = dict(zip([key for _, key in searches], hot_keys_together(searches, layout.slice_rows), strict=True)) if searches else {}
    by_facility = None if layout.small_facilities else deal(named, d, o, layout.slice_rows, hot[d])
    by_origin, carried = None, False
    if bucketed is not None:
        by_origin = Dealt(pairs, bucketed.hot, o)
    elif not layout.small_origins:
        carried = by_facility is not None and "e3sfca" in methods
        # Routes to nowhere, perhaps many of one origin, have no capacity to get.
        nowhere = pairs.filter(F.col(d) == _NO_DESTINATION).withColumn("_supply", F.lit(None).cast("double"))
        whole = by_facility.attach(known, "left").drop(SLICE).unionByName(nowhere) if carried else pairs
        by_origin = deal(whole, o, d, layout.slice_rows, hot[o])

    def with_origins(lookup: DataFrame) -> DataFrame:
        if layout.small_origins:
            return pairs.drop(SLICE).join(F.broadcast(lookup), o)
        return by_origin.attach(lookup, "inner").drop(SLICE)

    def with_facilities(lookup: DataFrame, how: str) -> DataFrame:
        """Leaves the pairs where they lie, dealt by origin or not, if facilities can be broadcast."""
        if by_facility is None:
            lying = pairs if by_origin is None else by_origin.pairs
            return lying.join(F.broadcast(lookup), d, how)
        return by_facility.attach(lookup, how).drop(SLICE)

    def with_totals(rows: DataFrame, lookup: DataFrame) -> DataFrame:
        """Pairs dealt by origin are still where they were; pairs dealt by facility are dealt once more."""
        if layout.small_origins:
            return rows.join(F.broadcast(lookup), o)
        lying = Dealt(rows, by_origin.hot, o) if by_facility is None else deal(rows, o, d, layout.slice_rows, by_origin.hot)
        return lying.attach(lookup, "inner")

    per_origin = people
    if "3sfca" in methods or "e3sfca" in methods:
        # An origin's total of decay counts every destination, its total of capacity times decay only facilities.
        reached = pairs if by_origin is None else by_origin.pairs
        if "e3sfca" in methods and not carried:
            reached = with_facilities(known, "left")
            if by_facility is not None:
                nowhere = pairs.filter(F.col(d) == _NO_DESTINATION).drop(SLICE)
                reached = reached.unionByName(nowhere.withColumn("_supply", F.lit(None).cast("double")))
        total_sums = {
            "3sfca": {"_total_f": F.col("_f")},
            "e3sfca": {"_total_sf": F.col("_supply") * F.col("_f")},
        }
        if carried:
            # This pass and the next take the same shuffle only if both read all its columns. Every
            # destination passes the test here, and every known one that below.
            anywhere = F.col(d) != F.lit(_NOT_A_KEY)
            total_sums = {m: {name: F.when(anywhere, term) for name, term in terms.items()} for m, terms in total_sums.items()}
        totals = sum_per_key(reached, o, _sums(total_sums, methods, F.sum))
        per_origin = people.join(totals, o, "left")

    demand_sums = {
        "2sfca": {"_d_2sfca": F.col("_people")},
        "e2sfca": {"_d_e2sfca": F.col("_people") * F.col("_f")},
        "m2sfca": {"_d_e2sfca": F.col("_people") * F.col("_f")},
        "3sfca": {"_d_3sfca": _share("_f", "_total_f") * F.col("_people") * F.col("_f")},
        # Capacity is constant per destination and is multiplied in after the sum.
        "e3sfca": {"_d_e3sfca": _share("_f", "_total_sf") * F.col("_people") * F.col("_f")},
    }
    if carried:
        # Only known facilities need their demand.
        demand_sums = {
            m: {name: F.when(F.col("_supply").isNotNull(), term) for name, term in terms.items()} for m, terms in demand_sums.items()
        }
    demand = sum_per_key(with_origins(per_origin), d, _sums(demand_sums, methods))

    s = F.col("_supply")
    ratios = {
        "2sfca": lambda: safe_ratio(s, F.col("_d_2sfca"), params.zero_demand),
        "e2sfca": lambda: safe_ratio(s, F.col("_d_e2sfca"), params.zero_demand),
        "m2sfca": lambda: safe_ratio(s, F.col("_d_e2sfca"), "zero"),
        "3sfca": lambda: safe_ratio(s, F.col("_d_3sfca"), "zero"),
        "e3sfca": lambda: s * positive_ratio(s, s * F.col("_d_e3sfca")),
    }
    per_facility = supply.join(demand, d, "inner").select(
        d, *[ratios[m]().alias(f"_r_{m}") for m in methods]
    )

    score_sums = {
        "2sfca": {"_s_2sfca": F.col("_r_2sfca")},
        "e2sfca": {"_s_e2sfca": F.col("_r_e2sfca") * F.col("_f")},
        "m2sfca": {"_s_m2sfca": F.col("_r_m2sfca") * F.col("_f") * F.col("_f")},
        "3sfca": {"_s_3sfca": F.col("_r_3sfca") * F.col("_f") * F.col("_f")},
        "e3sfca": {"_s_e3sfca": F.col("_r_e3sfca") * F.col("_f") * F.col("_f")},
    }
    scored = with_facilities(per_facility, "inner")
    divisor = {"3sfca": "_total_f", "e3sfca": "_total_sf"}
    if narrow and any(m in divisor for m in methods):
        scored = with_totals(scored, per_origin)
        score_sums |= {
            m: {f"_s_{m}": _share("_f", total) * F.col(f"_r_{m}") * F.col("_f")} for m, total in divisor.items()
        }
        divisor = {}
    scores = sum_per_key(scored, o, _sums(score_sums, methods))

    def final(method: str) -> Column:
        score = F.col(f"_s_{method}")
        if method in divisor:
            score = positive_ratio(score, F.col(divisor[method]))
        score = F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))
        return (score * F.lit(float(scale))).alias(f"SPAI_{method}")

    ids = origins.select(F.col(cols.join_id).alias(o), cols.point)
    table = ids.join(scores, o, "left")
    if any(m in divisor for m in methods):
        table = table.join(totals, o, "left")
    return table.select(cols.point, *[final(m) for m in methods])


def _share(part: str, total: str) -> Column:
    return positive_ratio(F.col(part), F.col(total))


def _sums(
    terms: dict[str, dict[str, Column]],
    methods: Sequence[str],
    total: Callable[[Column], Column] = nan_safe_sum,
) -> dict[str, Column]:
    """The aggregates that ``methods`` need; methods may share one."""
    return {
        name: total(term)
        for method in methods
        for name, term in terms.get(method, {}).items()
    }
