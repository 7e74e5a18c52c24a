"""Operator 12, cross-tokenizer alignment by a hash-set intersection of cumulative ends.

Both tokenizers' ids of a text come with the byte offsets at which their tokens end.  Two
dictionaries from end to index are intersected as hash sets; the sorted common keys slice both id
lists into groups, and the tokens of a slice that end at its key are its links.

Prose repeats words, so the slices of a *unit* (blanks and what follows them, up to the next blank
after it) are found once and kept in a bounded memo; the units of a text that are not in it are
encoded in one string.  This is exact: tokenizer A never puts a blank
behind another character into one piece, and no piece of B has a blank behind another character (if
one does, units are not used), so neither tokenizer looks across a unit's end and every such end is
common to both.  A text in which any bytes differ is encoded as a whole.

Links are counted corpus-wide by id pair.  The counted pairs are broadcast while they are fewer
than ``BROADCAST_PAIRS``, else joined; the result is the same (tested).

Defined results: texts that are null, empty or whose tokens do not spell them have zeros and the
text ''; repeated rows count as often as they occur; ties for a B id's highest count are all best;
an empty table gives no rows; further columns come along where ``keep`` names them, those of the
result excepted.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import materialize, text_of

RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Pairs of ids (8 bytes each, with a count) that may be broadcast.
BROADCAST_PAIRS = 1_000_000
#: Units of the newer of two generations that a worker keeps, and characters of the longest.
MEMO, UNIT = 120_000, 64
#: Rows whose links a worker holds at once.
ROWS = 128
#: A unit ends before a blank that follows something else.
UNITS = re.compile(r"(?<=\S)(?= )")
BLANK_BEFORE_BLANK = re.compile(r"\s ")
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: A pair of ids in one long.
SHIFT = 32


NOTHING = (0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def ends_blank(unit: str) -> bool:
    """Only the last unit of a text can."""
    return not unit or unit[-1].isspace()


#: What a part of a text has: A tokens, B tokens, groups, the groups as text, id pairs of the links.
Slices = tuple[int, int, int, str, list[int]]


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, model_a: str, model_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(model_a.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_file=model_b)
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.encode_a = fast.encode_ordinary
        self.encode_b = lambda text: pieces.encode(text, num_threads=1)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(n)) and pieces.is_byte(i)
                        else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.bare = not all(self.sizes_b) or not all(ranks)
        self.split = not any(re.search("[^▁]▁", n) for n in names)
        self.names = [str(i) for i in range(max(len(names), len(self.bytes_a)))]
        self.memo: dict[str, Slices] = {}
        self.older: dict[str, Slices] = {}

    def slices(self, spaced: str, stops: list[int]) -> list[Slices] | None:
        """Groups and links of a text with a leading blank, part by part.

        ``stops`` are the bytes at which its parts end, the text's end last.
        None if the tokens do not spell the text or no common end is at a stop.
        """
        a, b = self.encode_a(spaced), self.encode_b(spaced[1:])
        want = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        ends_a = list(accumulate(map(self.sizes_a.__getitem__, a)))
        ends_b = list(accumulate(map(self.sizes_b.__getitem__, b)))
        at_a, at_b = dict(zip(ends_a, range(len(a)))), dict(zip(ends_b, range(len(b))))
        common = at_a.keys() & at_b.keys()
        if not common.issuperset(stops):
            return None
        keys = sorted(common)
        last_a, last_b = [at_a[e] for e in keys], [at_b[e] for e in keys]
        first_a, first_b = [0, *[i + 1 for i in last_a]], [0, *[j + 1 for j in last_b]]
        groups = list(map("|".join, zip(self.said(a, first_a, last_a), self.said(b, first_b, last_b))))
        if self.bare:  # an id without bytes ends where the one before it ends
            links = [[x << SHIFT | y for x, e in zip(a[i:k + 1], ends_a[i:k + 1]) if e == end
                      for y, f in zip(b[j:m + 1], ends_b[j:m + 1]) if f == end]
                     for end, i, k, j, m in zip(keys, first_a, last_a, first_b, last_b)]
        else:
            links = [a[i] << SHIFT | b[j] for i, j in zip(last_a, last_b)]
        parts, low = [], 0
        for high in np.searchsorted(keys, stops, side="right").tolist():
            own = links[low:high]
            parts.append((first_a[high] - first_a[low], first_b[high] - first_b[low], high - low,
                          ";".join(groups[low:high]), list(chain.from_iterable(own)) if self.bare else own))
            low = high
        return parts

    def said(self, ids: list[int], first: list[int], last: list[int]) -> list[str]:
        names = [self.names[i] for i in ids]
        return [names[i] if i == k else ",".join(names[i:k + 1]) for i, k in zip(first, last)]

    def whole(self, text: str) -> Slices | None:
        parts = self.slices(" " + text, [len(text.encode()) + 1])
        return parts and parts[0]

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first blank."""
        if not self.split:
            return [text]
        if BLANK_BEFORE_BLANK.search(" " + text):
            return [u[1:] for u in UNITS.split(" " + text)]
        return text.split(" ")

    def parts_of(self, units: Iterable[str]) -> dict[str, Slices] | None:
        """The slices of each unit; those not in the memo are encoded in one go."""
        found, new, memo, older = {}, [], self.memo, self.older
        for u in units:
            part = memo.get(u)
            if part is None:
                part = older.get(u)
                if part is None:
                    new.append(u)
                    continue
                memo[u] = part
            found[u] = part
        if new:
            new.sort(key=ends_blank)
            stops = list(accumulate([len(u.encode()) + 1 for u in new]))
            made = self.slices("".join([" " + u for u in new]), stops)
            if made is None:
                return None
            for u, part in zip(new, made):
                found[u] = part
                if len(u) <= UNIT:
                    memo[u] = part
        if len(memo) > MEMO:
            self.memo, self.older = {}, memo
        return found

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray] | None:
        """(A tokens, B tokens, groups, digest of the groups, id pairs, links of each); None without tokens."""
        if not text or "▁" in text:
            return None
        units = self.units(text)
        found = Counter(units)
        parts = self.parts_of(found)
        if parts is None:
            units, found, parts = [text], Counter([text]), {text: self.whole(text)}
            if parts[text] is None:
                return None
        often = list(found.values())
        n_a, n_b, n_groups, _, links = zip(*[parts[u] for u in found])
        total = lambda each: sum(map(mul, often, each))
        times = np.repeat(np.array(often, dtype=np.float64), [len(x) for x in links])
        pairs, place = np.unique(np.fromiter(chain.from_iterable(links), np.int64, len(times)), return_inverse=True)
        digest = hashlib.sha256()
        for at in range(0, len(units), 4096):
            said = ";".join([parts[u][3] for u in units[at:at + 4096]])
            digest.update((";" + said if at else said).encode())
        return total(n_a), total(n_b), total(n_groups), digest.hexdigest(), pairs, np.bincount(place, times).astype(np.int64)


@lru_cache(maxsize=2)
def pair_of(model_a: str, model_b: str) -> Pair:
    return Pair(model_a, model_b)


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _align(model_a: str, model_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(model_a, model_b)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                at = b.schema.get_field_index("_text")
                found = [both.align(t.as_py()) or NOTHING for t in b.column(at)]
                made = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                made += [pa.array([f[3] for f in found], pa.string()),
                         pa.array([f[4] for f in found], pa.list_(pa.int64())),
                         pa.array([f[5] for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i) for i in range(b.num_columns) if i != at], *made],
                    [*[n for n in b.schema.names if n != "_text"], "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: corpus-wide links of each id pair, and whether its B id has no higher."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("l.pairs", "l.times")
    counted = materialize(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    top = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    return (counted.withColumn("b", b_id).join(top, "b", "inner")
            .select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def align(docs: DataFrame, text: str = "text", models: tuple[str, str] | None = None,
          keep: tuple[str, ...] = ("doc_id",), broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``keep`` and, for every row, its tokens, groups, links and how common its links are."""
    names = [c for c in keep if c not in RESULT]
    slots = [f"k{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(names, slots)], text_of(f"`{text}`").alias("_text"))
    kinds = "".join(f"{s} {rows.schema[s].dataType.simpleString()}, " for s in slots)
    aligned = rows.mapInArrow(_align(*(models or default_models())),
                              f"{kinds}n_a long, n_b long, n_groups long, groups_sha256 string, "
                              "pairs array<long>, times array<long>")
    aligned = materialize(aligned.withColumn("_tag", F.monotonically_increasing_id()), "aligned")
    counted = materialize(pair_counts(aligned), "counted")
    if counted.count() <= broadcast_pairs:
        counted = F.broadcast(counted)
    links = (aligned.select("_tag", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
             .select("_tag", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
             .join(counted, "pair", "inner"))
    sums = links.groupBy("_tag").agg(F.sum("times").alias("n_links"),
                                     F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (aligned.drop("pairs", "times").join(sums, "_tag", "left")
            .select(*[F.col(s).alias(c) for s, c in zip(slots, names)], "n_a", "n_b", "n_groups",
                    zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"))
