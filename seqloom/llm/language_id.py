"""Language identification by rank-order profiles of character n-grams.

Words are runs of letters, lower-cased and bounded by a blank; the n-grams of
one to three characters inside a bounded word are counted. A language's profile
lists its most frequent n-grams in the learning texts by rank. A document's own
ranking is compared with each profile: an n-gram adds the difference of its
ranks, or the largest possible difference if the profile lacks it. The language
with the smallest sum (out-of-place distance) wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_batches import slices

PROFILE_GRAMS = 400
#: Bound on the learned languages (profiles are broadcast: languages x PROFILE_GRAMS ranks).
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
#: Distinct (language, n-gram) counts a task holds before it hands them on.
HELD_COUNTS = 1_000_000
#: Text handled at once; n-grams take some 100 bytes per character.
SLICE_BYTES = 1 << 19
BLANK = 1  # stands for what is between words; 0: no character


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of every n-gram of every text, sorted by text and n-gram.

    An n-gram packs three characters of 21 bits; shorter ones end in zeros.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    rows = np.repeat(np.arange(len(lowered)), size)
    letter = letters[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.cumsum(size)
    keep[ends - 1] = True
    keep[ends - size] = True
    stream = np.where(letter, codes, BLANK)[keep]
    rows = rows[keep]
    seen = np.zeros(0x110000, bool)
    seen[stream] = True
    alphabet = np.flatnonzero(seen)  # sorted, so ties do not depend on the batch
    bits = max(1, int(len(alphabet)).bit_length())
    dense = np.zeros(0x110000, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    c = dense[stream]
    blank = int(dense[BLANK])
    c0, c1, c2 = c, np.append(c[1:], blank), np.append(c[2:], [blank, blank])[: len(c)]
    use = ~((c0 == blank) & (c1 == blank))
    if 3 * bits + max(1, len(texts)).bit_length() > 62:
        half = len(texts) // 2
        if half:
            a, b = gram_counts(texts[:half], letters), gram_counts(texts[half:], letters)
            return tuple(np.concatenate([x, y + half if k == 0 else y]) for k, (x, y) in enumerate(zip(a, b, strict=True)))
    key = (((rows.astype(np.int64) << bits | c0) << bits | c1) << bits | c2)[use]
    key.sort()
    out_row, out_gram, out_count = [], [], []
    mask = (1 << bits) - 1
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tri, count = key[first], np.diff(np.append(first, len(key)))
    for n in (3, 2, 1):
        if n < 3:  # a shorter n-gram occurs as often as all windows that begin with it
            short = tri >> (bits * (3 - n))
            first = np.flatnonzero(np.diff(short, prepend=-1))
            part, total = short[first], np.add.reduceat(count, first) if len(first) else count[:0]
        else:
            part, total = tri, count
        chars = [(part >> (bits * (n - 1 - k))) & mask for k in range(n)]
        ok = {3: lambda x: x[1] != blank, 2: lambda x: np.ones(len(x[0]), bool), 1: lambda x: x[0] != blank}[n](chars)
        gram = np.zeros(len(part), np.int64)
        for k in range(n):
            gram |= alphabet[chars[k]].astype(np.int64) << (21 * (2 - k))
        out_row.append((part >> (bits * n))[ok])
        out_gram.append(gram[ok])
        out_count.append(total[ok])
    row, gram, count = (np.concatenate(x) for x in (out_row, out_gram, out_count))
    order = np.lexsort((gram, row))
    return row[order], gram[order], count[order]


def learn_profiles(
    documents: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE_GRAMS
) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams in order, from all rows with a language and a text.

    Tasks add up their counts before the one shuffle (by language and n-gram); the ranking keeps
    ``size`` rows per language. Only the profiles reach the driver; more than ``MAX_LANGUAGES`` raise.
    """
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        held: dict[str, list] = {}
        n_held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                gram, total = _added(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(total)], names=["lang", "gram", "n"]
                )
            held.clear()

        for b in slices(batches, "text", SLICE_BYTES):
            names = np.array(b.column("lang").to_pylist(), dtype=object)
            row, gram, n = gram_counts(b.column("text").to_pylist(), letters)
            of = names[row] if len(row) else names[:0]
            for name in set(names):
                mine = of == name
                held.setdefault(name, []).append((gram[mine], n[mine]))
            n_held += len(gram)
            if n_held > 4 * HELD_COUNTS:
                for name in held:
                    held[name] = [_added(held[name])]
                n_held = sum(len(p[0][0]) for p in held.values())
                if n_held > HELD_COUNTS:
                    yield from hand_on()
                    n_held = 0
        yield from hand_on()

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "gram", "rank")
    found = ranked.limit(MAX_LANGUAGES * size + 1).collect()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram = np.concatenate([g for g, _ in parts])
    unique, at = np.unique(gram, return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(unique)).astype(np.int64)


class Profiles:
    """Profiles as one sorted n-gram list with a rank per language (``size`` where a language lacks it)."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_GRAMS):
        self.size = size
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)  # the last row: no profile has it
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def classify(self, texts: list[str], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        row, gram, count = gram_counts(texts, letters)
        order = np.lexsort((gram, -count, row))
        row, gram = row[order], gram[order]
        per_text = np.bincount(row, minlength=len(texts))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        top = rank < self.size
        row, gram, rank = row[top], gram[top], rank[top]
        used = np.bincount(row, minlength=len(texts))
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams)) if len(self.grams) else at
        away = np.empty((len(texts), len(self.names)))
        for k in range(len(self.names)):
            theirs = self.ranks[at, k]
            d = np.where(theirs < 0, self.size, np.abs(theirs - rank))
            away[:, k] = np.bincount(row, weights=d, minlength=len(texts))
        best = np.argmin(away, axis=1)
        score = 1.0 - away[np.arange(len(texts)), best] / np.maximum(used * self.size, 1)
        return (
            [self.names[k] if n else UNDETERMINED for k, n in zip(best, used, strict=True)],
            np.where(used > 0, np.clip(score, 0.0, 1.0), 0.0),
        )


def identify_languages(
    documents: DataFrame, profiles: dict[str, list[int]], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (names: ``out``) (0 to 1: one less the mean out-of-place distance) to every row.

    Only the text is looked at. ``und`` and 0 if the text is null or has no letter, or if nothing was
    learned; languages at the same distance: the first by name. Existing columns named as
    ``out`` are replaced. Narrow: no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    rows = documents.drop(*out)
    schema = T.StructType(list(rows.schema.fields)).add(out[0], "string").add(out[1], "double")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, letters = Profiles(shared.value), letter_table()
        for b in slices(batches, text, SLICE_BYTES):
            pred, score = learned.classify([t or "" for t in b.column(at).to_pylist()], letters)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, *out]
            )

    return rows.mapInArrow(run, schema)
