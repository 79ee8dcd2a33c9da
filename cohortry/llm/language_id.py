"""Language identification by compression.

One zstandard raw-content dictionary per language; a text belongs to the language whose dictionary compresses it best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import id_remainder

#: The bounded sample: so many distinct texts a language, so many characters of each.
SAMPLE_TEXTS = 96
SAMPLE_CHARS = 1500
LEVEL = 3
#: Texts are compressed in pieces, so that a long text leans on the dictionary and not on itself.
PIECE = 4096
#: Rows of a batch that are turned into texts and handed back at a time: whole batches hold 10,000 texts.
PASSED_ROWS = 256
#: Least lead of the best language over the second, in compressed bytes per 100 bytes of text.
MIN_MARGIN = 0.1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def dictionaries(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language from labelled ``docs`` (text, lang).

    Distinct texts with the smallest hashes are taken, so copies count once and reruns agree. At most
    ``texts * chars`` characters a language come to the driver.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    first = Window.partitionBy("lang").orderBy("h")
    picked = (rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("k", F.row_number().over(first)).filter(F.col("k") <= texts).select("h").collect())
    hashes = [r.h for r in picked]
    sample = (rows.filter(F.col("h").isin(hashes)).groupBy("lang", "h")
              .agg(F.min(F.substring("text", 1, chars)).alias("text")).collect())
    content: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r.lang, r.h)):
        content.setdefault(row.lang, []).append(letters(row.text))
    return {lang: " ".join(parts).encode() for lang, parts in _agreeing(content).items()}


def letters(text: str) -> str:
    """Lower-case letters, everything else as single spaces: shouting, symbols and layout say nothing of the language."""
    return _OTHER.sub(" ", text.lower())


def _agreeing(content: dict[str, list[str]]) -> dict[str, list[str]]:
    """Leave out mislabelled texts: each half of the sample is predicted from the other half and must agree.

    A language that would lose more than half of its texts keeps them all.
    """
    halves = [{lang: " ".join(t[k::2]).encode() for lang, t in content.items() if t[k::2]} for k in (0, 1)]
    models = [Identifier(h) for h in halves]
    out = {}
    for lang, texts in content.items():
        good = [t for i, t in enumerate(texts) if models[1 - i % 2].predict(t)[0] == lang]
        out[lang] = good if 2 * len(good) >= len(texts) else texts
    return out


class Identifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs, self.compressors = sorted(content), []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (per 100 bytes). No letters or no learned language: ``und``, 0, 0."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes, total, text = np.zeros(len(self.langs)), 0, letters(text)
        for lo in range(0, len(text), PIECE):
            piece = text[lo: lo + PIECE].encode("utf-8", "replace")
            total += len(piece)
            sizes += [len(c.compress(piece)) for c in self.compressors]
        best = int(sizes.argmin())
        share = np.exp(-(sizes - sizes[best]) / max(2.0, 0.01 * total))
        rest = np.delete(sizes, best)
        margin = float(rest.min() - sizes[best]) / total * 100 if len(rest) else 100.0
        return self.langs[best], float(1.0 / share.sum()), margin


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_margin; clashing columns of the input are replaced.

    The smallest compressed size decides, ties go to the first language by name. NULL, empty and letterless texts are
    ``und``. Every text is read whole. Rows stay as they are, repeated ones too.
    """
    added = {"lang_pred": "string", "lang_score": "double", "lang_margin": "double"}
    kept = docs.drop(*added)
    schema = ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + [f"{n} {t}" for n, t in added.items()])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(content)
        for batch in batches:
            for lo in range(0, batch.num_rows, PASSED_ROWS):
                some = batch.slice(lo, PASSED_ROWS)
                got = [model.predict(x) for x in some.column(at).to_pylist()]
                new = [pa.array([g[k] for g in got], pa.string() if not k else pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, *added])

    return kept.mapInArrow(run, schema)


def learn(docs: DataFrame, **bounds) -> dict[str, bytes]:
    """Dictionaries from the documents that are not held out (crc32 of the id, modulo 4, is not 2)."""
    return dictionaries(docs.filter(id_remainder(F.col("doc_id"), 4) != 2), **bounds)


def accepted(margin: str = "lang_margin", least: float = MIN_MARGIN):
    """Whether an identified row is kept: a language was found and its lead is no narrower than ``least``."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col(margin) >= least)
