"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content dictionary of its texts. A text is cut into blocks, every block is
compressed with every dictionary, and the smallest total names the language; a narrow margin to the next
one rejects the text. A block follows the start of the dictionary, whose own size is taken off again: so
even a few words are compressed, where alone they would be stored as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.session import bounded_batches, id_crc32, map_arrow, widened

#: Of each language, at most so many texts are learnt from, and so many characters of each. A dictionary has at most
#: DICTIONARY_BYTES of them, so where texts are long it has only the first 16 or so whole.
SAMPLE_TEXTS, SAMPLE_CHARS = 96, 4096

#: More languages than this are taken for a mistake in the labels.
MOST_LANGUAGES = 1000

DICTIONARY_BYTES, LEVEL, BLOCK_BYTES, CARRIER_BYTES = 65536, 6, 4096, 512

#: Rejected if the smallest total is less than this share below the next one.
MARGIN = 0.002

#: Bits by which a total must be smaller for a factor of e in the score.
SCORE_BITS = 24.0

UNDETERMINED = "und"


class Classifier:
    """Compressors with the dictionaries of some languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors, self.carriers, self.carried = [], [], []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(
                dictionaries[language] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=LEVEL)
            compressor = zstandard.ZstdCompressor(
                dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.compressors.append(compressor)
            self.carriers.append(dictionaries[language][:CARRIER_BYTES] + b" ")
            self.carried.append(len(compressor.compress(self.carriers[-1])))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a whole text under each language; blocks keep it from explaining itself."""
        data = text.lower().encode()
        parts = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        each = zip(self.compressors, self.carriers, self.carried, strict=True)
        return [sum(len(c.compress(start + part)) - own for part in parts) for c, start, own in each]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and margin; a text that is null or has no letter is undetermined, 0, 0.

        Equal totals go to the language that comes first by name, with margin 0.
        """
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = np.array(self.sizes(text), float)
        order = np.argsort(sizes, kind="stable")
        least = sizes[order[0]]
        margin = float((sizes[order[1]] - least) / max(1.0, sizes[order[1]])) if len(order) > 1 else 1.0
        score = float(1 / np.exp(8 * (least - sizes) / SCORE_BITS).sum())
        return self.languages[order[0]], score, margin


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _joined(pieces: list[str]) -> bytes:
    return b"\n".join(p.lower().encode() for p in pieces)[:DICTIONARY_BYTES]


def build_dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """A dictionary of each language from its sample texts.

    Labels may be wrong: each half of a sample is first classified with dictionaries of the other halves,
    and texts that come out as another language are left out, unless none would be left.
    """
    halves = [{k: v[i::2] or v for k, v in samples.items()} for i in (0, 1)]
    clean: dict[str, list[str]] = {k: [] for k in samples}
    for own, other in (halves, halves[::-1]):
        judge = Classifier({k: _joined(v) for k, v in other.items()})
        for language, pieces in own.items():
            clean[language] += [p for p in pieces if judge.classify(p)[0] == language]
    return {k: _joined(clean[k] or v) for k, v in samples.items()}


def held_out():
    """Rows that are never learnt from."""
    return F.coalesce(id_crc32() % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the texts and non-null languages of rows of docs (doc_id, text, lang) not held out.

    The sample of a language is bounded by SAMPLE_TEXTS and SAMPLE_CHARS, its dictionary by DICTIONARY_BYTES; its texts are those with the least
    hashed ids. Each task keeps its own least ones before anything is shuffled.
    """
    rows = docs.where("lang is not null and text is not null").where(~held_out())
    piece = F.substring("text", 1, SAMPLE_CHARS)
    lang = F.col("lang").cast("string").alias("lang")
    rows = rows.select(lang, piece.alias("piece"), F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    picked = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS)
    samples: dict[str, list[str]] = {}
    for row in picked.select("lang", "rank", "piece").orderBy("lang", "rank").toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["piece"])
        if len(samples) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return build_dictionaries(samples)


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(dictionaries))


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN, prefix: str = ""
) -> DataFrame:
    """docs with lang_pred, score, margin and rejected, from the column text alone; prefix is put before the names.

    lang_pred is ``und`` and the row rejected if the text is null or has no letter; otherwise it is the
    language of the smallest total, and rejected tells whether its margin is below the one given. Input
    columns of the four names are replaced; all others stay.
    """
    bounded_batches(docs.sparkSession)
    kinds = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
    kinds = {prefix + name: kind for name, kind in kinds.items()}
    kept = docs.drop(*kinds)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _classifier(sent.value)
        for batch in batches:
            found = [judge.classify(t) for t in batch.column(text).to_pylist()]
            columns = [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.float64()),
                pa.array([x[0] == UNDETERMINED or x[2] < margin for x in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *kinds])

    return map_arrow(kept, run, widened(kept, **kinds))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every row of docs (doc_id, text, lang).

    Learns from the rows that aren't held out. Null and letterless texts are ``und`` with score 0; with no
    labelled row at all every text is. A null doc_id isn't held out. Repeated rows are returned each; extra
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(rows, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
