"""Language identification by compression.

Each learned language is a zstandard raw-content dictionary. A text is encoded with every dictionary,
in blocks so that a long text cannot serve as its own dictionary, and the language of the smallest total
wins. The relative gap to the runner-up is the score; gaps under ``margin`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import crc_mod, in_small_batches

#: Bounds of the fitted sample, per language: documents, bytes taken of one document, bytes of the dictionary.
SAMPLE_DOCS, SLICE_BYTES, DICT_BYTES = 96, 2048, 96 << 10
BLOCK_BYTES = 2048
MARGIN = 0.002
#: The lazy strategy with short matches: the fast ones find too little of a dictionary to tell languages apart.
ENCODER = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, slice_bytes: int = SLICE_BYTES, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """One dictionary per language from a bounded sample of labelled rows (text and lang not null).

    The sample is the rows of lowest hash: a first pass counts each language, a second keeps the share
    that yields a few times ``sample_docs`` rows, of which the lowest hashes stay. Of a long text a slice counts, from a place that
    its hash chooses. At most ``sample_docs * slice_bytes`` characters per language reach the driver. An empty table gives no language.
    """
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(h, F.greatest(F.length("text") - slice_bytes + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        F.col("lang").alias("_lang"), F.substring(F.col("text"), place, F.lit(slice_bytes)).alias("_part"), h.alias("_h")
    )
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * sample_docs / n + 16.0 / n))])
    unit = F.shiftrightunsigned("_h", 12) / F.lit(float(1 << 52))
    picked = rows.where(unit < share[F.col("_lang")]).orderBy("_h").limit(4 * (sample_docs + 16) * len(counts)).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        parts = [r["_part"].lower().encode() for r in sorted((r for r in picked if r["_lang"] == lang), key=lambda r: (r["_h"], r["_part"]))[:sample_docs]]
        # The end of a dictionary is nearest to the text; the newest slices stay when the bound is met.
        out[lang] = b"\n".join(parts)[-dict_bytes:] or b" "
    return out


def encoders(dictionaries: dict[str, bytes]) -> list:
    made, params = [], zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **ENCODER)
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return made


def classify(text: str | None, names: list[str], tools: list, margin: float = MARGIN, block: int = BLOCK_BYTES) -> tuple[str, float, bool]:
    """(language, score, rejected). Null texts, texts without a letter and an empty model give ``und``, 0 and rejected.

    Equal sizes go to the first language by name, with score 0 and rejected when there is a runner-up.
    """
    if not text or not names or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = text.lower().encode("utf-8", "surrogatepass")
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    sizes = np.array([sum(len(t.compress(b)) for b in blocks) for t in tools])
    # The frame costs the same bytes whatever the content is; without them short texts keep their gaps.
    sizes = np.maximum(sizes - 6 * len(blocks), 1)
    order = np.argsort(sizes, kind="stable")
    gap = 1.0 if len(names) == 1 else float(sizes[order[1]] - sizes[order[0]]) / float(sizes[order[1]])
    return names[order[0]], min(1.0, max(0.0, gap)), gap < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` plus lang_pred, score and rejected; columns of those names in the input are replaced."""
    names = list(dictionaries)
    docs = in_small_batches(docs).drop("lang_pred", "score", "rejected")
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoders(dictionaries)
        for batch in batches:
            got = [classify(t.as_py(), names, tools, margin) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(run, schema)


def _held_out():
    """Whether a row is held out; one without id is not."""
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learns from rows outside the held-out quarter and predicts every row from its text alone."""
    model = fit(docs.where(~_held_out()), **bounds)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose language is recognised, with their columns unchanged: what a cleaning stage keeps.

    Columns may have any names; they travel numbered beside the text.
    """
    model = fit(docs.where(~_held_out()))
    names = [c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    return predict(docs.toDF(*names), model).where((F.col("lang_pred") != UNKNOWN) & ~F.col("rejected")).select(*names).toDF(*docs.columns)
