"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram is the product of its
letters' vectors, each rotated by its place; a document is the sum over
its trigrams; a language is the sum of the unit vectors of its documents.
A document gets the language whose vector has the largest cosine with its own.

Letters are lower-cased; a to z have numbers of their own, other letters share 37
numbers by a hash of their code point, and a run of other characters counts
as one boundary.  Sums over documents are linear, so tasks add up vectors and only one
vector per task and language is shuffled.

Cases: a NULL text or one without letters is ``und`` with score 0; without any
labelled rows every text is ``und``; rows with a NULL language are not learned
from; ties go to the first language in order; repeated rows get equal results;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024
SEED = 20_240_501
LETTERS = 64
STRIP_DOCS = 64
# Vectors held at a time inside a task.
PART_DOCS = 512
STRIP_CHARS = 1 << 18
# At most about so many labelled documents of a language are learned from, chosen by hash.
TRAIN_DOCS = 20_000
MOST_LANGUAGES = 2_000
SHARDS = 64
SHARPNESS = 12.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_numbers() -> np.ndarray:
    """Per code point its letter number, 0 for what is no letter."""
    numbers = np.zeros(0x110000, dtype=np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], dtype=np.uint64)
    numbers[letters] = 27 + ((letters * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(LETTERS - 27)).astype(np.uint8)
    numbers[97:123] = np.arange(1, 27)
    return numbers


@lru_cache(maxsize=1)
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the first letter of a trigram, and of the other two bound together."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, DIMENSION))
    second, third = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    return letters, (second[:, None, :] * third[None, :, :]).reshape(LETTERS * LETTERS, DIMENSION)


def _trigrams(text: str) -> np.ndarray:
    codes = _letter_numbers()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    return (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]


def _strips(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Pieces of texts with their text's number; long texts in pieces that overlap by two characters."""
    strip, held = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text), 1), STRIP_CHARS):
            strip.append((number, text[at:at + STRIP_CHARS + 2]))
            held += len(strip[-1][1])
            if held >= STRIP_CHARS or len(strip) >= STRIP_DOCS:
                yield strip
                strip, held = [], 0
    if strip:
        yield strip


def bundles(texts: list[str]) -> np.ndarray:
    """One vector per text, zero without letters."""
    first, rest = _vectors()
    out = np.zeros((len(texts), DIMENSION), dtype=np.float32)
    for strip in _strips(texts):
        grams = [_trigrams(t) for _, t in strip]
        place = np.repeat(np.arange(len(strip)), [len(g) for g in grams])
        keys, counts = np.unique(place * LETTERS**3 + np.concatenate(grams), return_counts=True)
        used, column = np.unique(keys % LETTERS**3, return_inverse=True)
        table = np.zeros((len(strip), len(used)), dtype=np.float32)
        table[keys // LETTERS**3, column] = counts
        vectors = (first[used // LETTERS**2] * rest[used % LETTERS**2]).astype(np.float32)
        np.add.at(out, [n for n, _ in strip], table @ vectors)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for rows in frames:
        for at in range(0, len(rows), PART_DOCS):
            part = rows.iloc[at:at + PART_DOCS]
            vectors = _unit(bundles([t or "" for t in part["text"]]).astype(np.float64))
            languages = part["lang"].to_numpy(dtype=object)
            for language in set(languages):
                total[language] = total.get(language, 0) + vectors[languages == language].sum(0)
    if total:
        yield pd.DataFrame({"lang": list(total), "vector": [v.astype("<f8").tobytes() for v in total.values()]})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    vector = sum(np.frombuffer(v, dtype="<f8") for v in rows["vector"])
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "vector": [vector.tobytes()]})


def prototypes(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(lang, vector)``: the profile of each language, learned from all given rows or a bounded share of each language."""
    rows = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the language column holds something else")
    shares = [(r["lang"], train_docs / r["count"]) for r in counts if r["count"] > train_docs]
    if shares:
        share = F.create_map(*[F.lit(x) for pair in shares for x in pair])
        draw = F.pmod(F.xxhash64("text", F.lit("profile")), F.lit(1_000_000)) / 1e6
        rows = rows.filter(draw < F.coalesce(share[F.col("lang")], F.lit(1.0)))
    parts = rows.mapInPandas(_sums, "lang string, vector binary").withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(SHARDS)))
    return (
        parts.groupBy("lang", "shard").applyInPandas(_added, "lang string, vector binary")
        .groupBy("lang").applyInPandas(_added, "lang string, vector binary")
    )


def identify(docs: DataFrame, profiles: DataFrame, text_column: str = "text", prefix: str = "lang_") -> DataFrame:
    """The documents with ``pred``, ``score`` (0 to 1) and ``cosine`` under the given prefix."""
    known = profiles.limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} profiles")
    known = sorted((r["lang"], bytes(r["vector"])) for r in known)
    names = np.array([name for name, _ in known] or [UNKNOWN], dtype=object)
    table = _unit(np.array([np.frombuffer(v, dtype="<f8") for _, v in known]).reshape(-1, DIMENSION)).astype(np.float32)

    def of_part(texts: pd.Series) -> pd.DataFrame:
        vectors = bundles([t or "" for t in texts])
        empty = ~vectors.any(axis=1)
        if not len(table):
            nothing = np.zeros(len(texts))
            return pd.DataFrame({"pred": np.full(len(texts), UNKNOWN, dtype=object), "score": nothing, "cosine": nothing})
        cosine = (_unit(vectors) @ table.T).astype(np.float64)
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        odds = np.exp(SHARPNESS * (cosine - top[:, None]))
        return pd.DataFrame({
            "pred": np.where(empty, UNKNOWN, names[best]), "score": np.where(empty, 0.0, 1 / odds.sum(axis=1)), "cosine": np.where(empty, 0.0, top)})

    @F.pandas_udf("pred string, score double, cosine double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [of_part(texts.iloc[at:at + PART_DOCS]) for at in range(0, max(len(texts), 1), PART_DOCS)]
            yield pd.concat(parts, ignore_index=True)

    guessed = docs.withColumn(f"{prefix}guess", guess(F.col(text_column).cast("string")))
    return guessed.withColumns({f"{prefix}{f}": F.col(f"{prefix}guess")[f] for f in ("pred", "score", "cosine")}).drop(f"{prefix}guess")


def held_out(key: str | Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the key's text leaves the remainder; a NULL key counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == remainder

