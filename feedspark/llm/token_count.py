"""Token counts with a whole-token shortcut.

Vocabulary strings that encode alone as one token are proven once with the
tokenizer itself. Pre-tokens found among them count as one; the merges run only
on the rest, once for each different pre-token that a worker holds in its bounded memo.
Texts of all scripts are split here: for each character it is proven, too, that the tokenizer
takes it for the letter, number, space or other character that our pattern takes it for.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.shared import prepare, tidy

#: Pre-tokens of which a worker remembers the token count; the memo is emptied beyond that.
MEMO = 400_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64
#: Texts of characters below this one are split by a pattern that spells them out, which is faster.
FAST_BELOW = 0x250
#: Characters that go through the library in one call.
CALL_CHARS = 1 << 18


def _one_of(kinds: str, extra: str = "") -> str:
    return "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if unicodedata.category(chr(c))[0] in kinds) + extra


def fast_pattern() -> re.Pattern:
    """The byte-level pre-token pattern, spelled out for characters below ``FAST_BELOW``."""
    space = "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
    letter, number = _one_of("L"), _one_of("N")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def full_pattern() -> regex.Pattern:
    """The byte-level pre-token pattern for all characters."""
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _ranges(points: list[int]) -> str:
    """A character class's inside for ascending code points."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


@lru_cache(maxsize=4)
def odd_characters(text: str) -> str:
    """Characters from :data:`FAST_BELOW` on that the tokenizer may take for another kind than our pattern does, as the inside
    of a character class: those of unknown, private or surrogate code points, and all that a probe shows.

    Between two letters a letter makes one pre-token, between two digits a number does, between two marks anything
    else but a space.
    """
    pre = load(text).pre_tokenizer
    if pre is None:
        return _ranges(list(range(FAST_BELOW, 0x110000)))
    split, ours = pre.pre_tokenize_str, {k: regex.compile(rf"\p{{{k}}}") for k in ("L", "N", "White_Space")}
    kinds = {c: unicodedata.category(chr(c)) for c in range(FAST_BELOW, 0x110000)}
    known = [c for c, k in kinds.items() if k not in ("Cn", "Co", "Cs")]
    odd = [c for c, k in kinds.items() if k in ("Cn", "Co", "Cs")]
    one: dict[str, set[int]] = {}
    for kind, side in (("L", "a"), ("N", "1"), ("other", "!")):
        one[kind] = set()
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]
            # Probes stand apart by line ends; one is whole if a piece spans its three characters.
            for _, (lo, hi) in split("\n".join(f"{side}{chr(c)}{side}" for c in part)):
                if hi - lo == 3 and lo % 4 == 0:
                    one[kind].add(part[lo // 4])
    for c in known:
        x = chr(c)
        kind = next((k for k, p in ours.items() if p.match(x)), "other")
        if {k for k, v in one.items() if c in v} != ({kind} - {"White_Space"}):
            odd.append(c)
    return _ranges(sorted(odd))


def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def prove_single(text: str) -> list[str]:
    """The vocabulary strings that the tokenizer encodes, alone, as one token."""
    tok = load(text)
    known = sorted(tok.get_vocab().values())
    strings = [s for i in known if (s := tok.decode([i], skip_special_tokens=False)) and "�" not in s]
    return [s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1]


class Counter:
    """Counts the tokens of texts as the library does, for a byte-level BPE file without normaliser."""

    def __init__(self, text: str, single: list[str], odd: str | None = None) -> None:
        import json

        spec = json.loads(text)
        self.tok = load(text)
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        plain = plain and not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        self.pattern, self.full = (fast_pattern(), full_pattern()) if plain else (None, None)
        self.odd = regex.compile(f"[{odd_characters(text) if odd is None else odd}]") if plain else None
        self.added = [a["content"] for a in added]
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.rare = re.compile(f"[^\\x00-{chr(FAST_BELOW - 1)}]")
        self.single = dict.fromkeys((s for s in single if s not in set(self.added)), 1)
        self.memo = dict(self.single)

    def merged(self, pieces: list[str]) -> list[int]:
        """Token counts of strings by the library, in calls of bounded size."""
        out: list[int] = []
        at, size = 0, 0
        for i, p in enumerate(pieces):
            size += len(p)
            if size >= CALL_CHARS or i == len(pieces) - 1:
                out += [len(e.ids) for e in self.tok.encode_batch_fast(pieces[at : i + 1], add_special_tokens=False)]
                at, size = i + 1, 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts, taken in groups of about ``CALL_CHARS`` characters."""
        if self.pattern is None:
            return self.merged(texts)
        out, at, size = [], 0, 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= CALL_CHARS or i == len(texts) - 1:
                out += self.group(texts[at : i + 1])
                at, size = i + 1, 0
        return out

    def group(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        wide = [i for i, x in enumerate(texts) if not x.isascii() and self.rare.search(x)]
        whole = [i for i in wide if self.odd.search(texts[i])]
        for i, n in zip(whole, self.merged([texts[i] for i in whole]), strict=True):
            out[i] = n
        skip, wide = set(whole), set(wide)
        split = self.split
        found: list[tuple[int, list[str]]] = []
        for i, x in enumerate(texts):
            if i in skip or not x:
                continue
            find = (self.full if i in wide else self.pattern).findall
            if split is not None and split.search(x):
                parts = split.split(x)
                out[i] += len(parts) - 1
                found += [(i, find(part)) for part in parts]
            else:
                found.append((i, find(x)))
        different = set(chain.from_iterable(f for _, f in found))
        new = different.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo = dict(self.single)
            new = different.difference(self.memo)
        counts = dict(zip(new, self.merged(list(new)), strict=True))
        self.memo.update(counts)
        get = self.memo.__getitem__
        for i, f in found:
            out[i] += sum(map(get, f))
        for p in new:  # long strings aren't worth their memory
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns ``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``),
    one row for each input row in no set order. A null text counts as empty (0, 0,
    false); a null or repeated id is kept as it stands; other columns are ignored.
    No row leaves its partition, and a batch is bounded in rows and bytes.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast((text, prove_single(text), odd_characters(text)))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(*shared.value)
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counter.count(texts)
            size = [len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return out.mapInArrow(tidy(run), f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
