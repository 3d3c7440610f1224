"""Ids of byte-level BPE vocabularies, as the ``tokenizers`` library gives them.

A ``tokenizers`` file whose merges are numbered in their own order says the same as a list of ranks,
which ``tiktoken`` encodes several times faster; such files are encoded that way, but for texts with
endless white space. Those and any other file go to ``tokenizers`` itself, a ``.model`` file to
``sentencepiece``.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A lone space between two ASCII letters: the word before it ends and the next begins with it.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

#: White space of which the pattern's search would need too much stack; ``tokenizers`` has no such limit.
_LONG_BLANK = re.compile(r"\s{200000}")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """Rank of each byte string if the file is plain byte-level BPE, merged in the order of its ids."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special, of = {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
    return {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """The file in ``tokenizers``, whose tables take far more memory than ranks: loaded where it is needed."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[str], list[int]], int]:
    """A function from a text to its ids, without added begin or end, and the number of ids."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return pieces.encode, pieces.get_piece_size()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _as_ranks(spec)
    if ranks is None:

        def whole(text: str) -> list[int]:
            return _library(path).encode(text, add_special_tokens=False).ids

        whole.library = _library(path)
        return whole, whole.library.get_vocab_size()
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if _LONG_BLANK.search(text):
            return _library(path).encode(text, add_special_tokens=False).ids
        if any(s in text for s in special):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    encode.fast, encode.is_odd = fast, lambda text: bool(_LONG_BLANK.search(text)) or any(s in text for s in special)
    return encode, len({*spec["model"]["vocab"], *special})


@functools.lru_cache(maxsize=4)
def batch_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from many texts to their ids, in one call of the library, on the calling thread."""
    encode, _ = encoder(path)
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    fast = getattr(encode, "fast", None)
    if fast is None:
        library = encode.library
        return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    def each(texts: list[str]) -> list[list[int]]:
        # Few texts need more than the plain call.
        odd = {i: encode(t) for i, t in enumerate(texts) if encode.is_odd(t)}
        plain = iter(fast.encode_ordinary_batch([t for i, t in enumerate(texts) if i not in odd], num_threads=1))
        return [odd[i] if i in odd else next(plain) for i in range(len(texts))]

    return each


def segments(text: str, size: int) -> list[str]:
    """Cuts a long text so that the ids of the parts, joined, are those of the whole.

    Parts have some ``size`` characters. Where none of the next characters is a safe place, the part
    simply runs on: a text without any is encoded whole.
    """
    parts, at = [], 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts
