"""The run from three stored tables to a CSV folder, as a function and as a command."""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from ..config import METHODS, Columns, Params
from ..operators import dedupe_od, store_pairs, validate_facilities, validate_od, validate_origins, within_catchment
from ..sources import read_facilities, read_od, read_origins, write_csv
from ..storage import can_store
from .fused import accessibility

#: Formats that are read again at the cost of a few columns; others are parsed once and stored.
COLUMNAR = ("parquet", "orc", "table")


def run(
    spark: SparkSession,
    od: str,
    origins: str,
    facilities: str,
    output: str,
    *,
    fmt: str = "parquet",
    methods: Sequence[str] = METHODS,
    params: Params = Params(),
    cols: Columns = Columns(),
    destination_id_col: str | None = None,
    id_type: str = "long",
    scale: float = 1.0,
    check_pairs: bool = False,
    dedupe: bool = False,
    options: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
    store: bool | None = None,
    count_pairs: bool = False,
    infinity: str = "Infinity",
) -> int | None:
    """Reads, checks the ids, computes and writes.

    ``check_pairs`` also looks for repeated routes, which shuffles the travel-time table once more;
    ``dedupe`` keeps the shortest of them instead. ``options`` are the reader's, for all three tables.
    ``store`` says whether the routes within the threshold are stored between the passes; unless it is given
    that is so after ``dedupe`` and for formats that are no columnar tables, where there is a shared folder
    (``spark.checkpoint.dir``). With ``count_pairs`` their number is returned.
    """
    options = dict(options or {})
    od_df = read_od(spark, od, fmt, cols, destination_id_col=destination_id_col, id_type=id_type, options=options)
    origins_df = read_origins(spark, origins, fmt, cols, id_type=id_type, options=options)
    facilities_df = read_facilities(spark, facilities, fmt, cols, id_type=id_type, options=options)
    validate_origins(origins_df, cols)
    validate_facilities(facilities_df, cols)
    if dedupe:
        od_df = dedupe_od(od_df, cols)
    elif check_pairs:
        validate_od(od_df, cols)
    if store is None:
        store = (dedupe or fmt not in COLUMNAR) and can_store(spark)
    if store:
        od_df = store_pairs(od_df, params, cols)
    kept = within_catchment(od_df, params, cols).count() if count_pairs else None
    scores = accessibility(
        od_df, origins_df, facilities_df, methods=methods, params=params, cols=cols, scale=scale
    )
    write_csv(scores, output, cols, mode=mode, infinity=infinity)
    return kept


def main(argv: Sequence[str] | None = None) -> None:
    names = Columns()
    defaults = Params()
    parser = argparse.ArgumentParser(prog="isoreach", description=__doc__)
    for table in ("od", "origins", "facilities", "output"):
        parser.add_argument(f"--{table}", required=True)
    parser.add_argument("--format", default="parquet", help="parquet, csv, table, ...")
    parser.add_argument("--methods", nargs="+", choices=METHODS, default=list(METHODS))
    parser.add_argument("--d0", type=float, default=defaults.d0)
    parser.add_argument("--decay-f", type=float, default=defaults.decay_f)
    parser.add_argument("--decay", choices=("gaussian", "linear"), default=defaults.decay)
    parser.add_argument("--zero-demand", choices=("inf", "zero"), default=defaults.zero_demand)
    fields = ("origin", "name", "time", "point", "population", "join_id", "facility", "capacity")
    for field in fields:
        parser.add_argument(f"--{field.replace('_', '-')}-field", default=getattr(names, field))
    parser.add_argument("--destination-id-field")
    parser.add_argument("--id-type", default="long")
    parser.add_argument("--scale", type=float, default=1.0)
    parser.add_argument("--check-pairs", action="store_true")
    parser.add_argument("--dedupe", action="store_true", help="keep the shortest of repeated routes")
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="of the reader")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--store", action=argparse.BooleanOptionalAction, help="store the routes between passes")
    parser.add_argument("--count-pairs", action="store_true", help="say how many routes are within d0")
    parser.add_argument("--infinity", default="Infinity", help="text of infinite scores")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("isoreach").getOrCreate()
    kept = run(
        spark,
        args.od,
        args.origins,
        args.facilities,
        args.output,
        fmt=args.format,
        methods=args.methods,
        params=Params(args.d0, args.decay_f, args.decay, args.zero_demand),
        cols=Columns(**{field: getattr(args, f"{field}_field") for field in fields}),
        destination_id_col=args.destination_id_field,
        id_type=args.id_type,
        scale=args.scale,
        check_pairs=args.check_pairs,
        dedupe=args.dedupe,
        options=dict(option.split("=", 1) for option in args.option),
        mode="overwrite" if args.overwrite else "errorifexists",
        store=args.store,
        count_pairs=args.count_pairs,
        infinity=args.infinity,
    )
    if kept is not None:
        print(f"{kept} routes within {args.d0} minutes")
    print(f"Accessibility scores written to {args.output}")
