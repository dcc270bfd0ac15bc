"""Language identification by compression against per-language raw-content dictionaries.

Each language gets a zstandard dictionary made of the whole raw texts of a bounded sample of rows. A text is cut into blocks (all of it is
read), every block is compressed against every dictionary, and the language with the smallest sum wins. A small block keeps
the dictionary in the reach of the coder, so late parts of a long text count as much as its start. Narrow margins are marked
in ``rejected``.

Defined results: ``und`` with score 0 for a null text, an empty text or one without a letter; equal sizes fall to the first
language in alphabetical order (score at most 1/2, rejected); repeated rows get repeated results; with nothing to learn from,
every text is ``und``; an empty table gives no rows; very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from smoothspan.llm.workers import returning_memory

UNKNOWN = "und"


@dataclass(frozen=True)
class ZstdSettings:
    """``sample_rows`` labelled rows of each language, with their whole texts (the bound of the fit); ``block_bytes`` is
    compressed at once; below ``min_margin`` a decision is marked rejected."""

    sample_rows: int = 60
    block_bytes: int = 4 << 10
    level: int = 5
    min_match: int = 4
    min_margin: float = 0.01


def fit_dictionaries(
    labelled: DataFrame,
    settings: ZstdSettings = ZstdSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """Dictionaries from the ``sample_rows`` rows of each language that come first by a hash of the id."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= settings.sample_rows).select("id").distinct()
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(picked), "id").where("lang is not null and text is not null").toPandas()  # bound: sample_rows per language
    out = {}
    for lang, part in found.sort_values(["lang", "id", "text"]).groupby("lang"):
        out[str(lang)] = b" ".join(part["text"].map(letters_only))
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


#: ASCII other than letters counts as a space.
_BLANKS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def letters_only(text: str) -> bytes:
    return text.lower().encode().translate(_BLANKS)


class ZstdClassifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: ZstdSettings):
        import zstandard as zstd

        self.settings = settings
        self.langs = list(dictionaries)
        self.coders = []
        reach = max(map(len, dictionaries.values()), default=0) + settings.block_bytes  # the coder sees whole dictionaries
        parameters = zstd.ZstdCompressionParameters.from_level(
            settings.level,
            min_match=settings.min_match,
            strategy=zstd.STRATEGY_GREEDY,
            window_log=min(27, max(17, reach.bit_length())),
            hash_log=17,
            chain_log=16,
            search_log=4,
            write_checksum=0,
            write_content_size=0,
            write_dict_id=0,
        )
        for content in dictionaries.values():
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.coders.append(zstd.ZstdCompressor(compression_params=parameters, dict_data=held))

    def sizes(self, text: str) -> np.ndarray:
        data, step = letters_only(text), self.settings.block_bytes
        total = [0] * len(self.coders)
        for at in range(0, len(data), step):
            block = data[at : at + step]
            for k, coder in enumerate(self.coders):
                total[k] += len(coder.compress(block))
        return np.array(total, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if not text or not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0, 0.0, True
        size = self.sizes(text)
        best = int(np.argmin(size))
        others = np.delete(size, best)
        margin = float((others.min() - size[best]) / size[best]) if len(others) else 1.0
        # Code lengths are negative log likelihoods; blocks of one text depend on each other, so they count by the byte only.
        score = float(1.0 / np.exp(-np.minimum(size - size[best], 700.0) * 0.1).sum())
        return self.langs[best], score, margin, margin < self.settings.min_margin


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:256])) or any(map(str.isalpha, text[256:]))


def identify_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], settings: ZstdSettings = ZstdSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ZstdClassifier(dictionaries, settings)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            lang, score, margin, rejected = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[id_col, "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select(id_col, F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {id_type}, lang_pred string, score double, margin double, rejected boolean"
    )
