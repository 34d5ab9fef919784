"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on good and one on bad labelled texts. A text is compressed with
each, in blocks of BLOCK_BYTES that all start from the bare dictionary, so that a long text
is judged like many short ones. The difference of the compressed sizes, relative to the
size of the text and to the compressed size, and the compressed share itself are the inputs
of a logistic calibrator fitted on labelled texts that are in neither dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.calibration import Logistic, fold, labelled_sample
from batchwright.llm.common import ids_and_text, map_batches, received, send

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 2000
#: Labelled texts of more characters are not used for fitting; they are scored like all others.
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 2048
LEVEL = 3
HELD_OUT_FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass
class QualityModel:
    """Plain values, so that it can be broadcast; about 2 * DICTIONARY_BYTES large."""

    good: bytes
    bad: bytes
    calibrator: Logistic


def blocks(data: bytes) -> list[bytes]:
    """The whole text in blocks; the last two share what is left so that no block is tiny."""
    n = max(1, round(len(data) / BLOCK_BYTES))
    cuts = [len(data) * i // n for i in range(n + 1)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            if content:
                dictionary = zstandard.ZstdCompressionDict(content)
                dictionary.precompute_compress(level=LEVEL)
                self.pair.append(self._compressor(dictionary))
            else:
                self.pair.append(self._compressor(None))

    @staticmethod
    def _compressor(dictionary):
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress

    def inputs(self, text: str) -> tuple[float, float, float]:
        """(difference per byte, difference per compressed byte, compressed share); zeros for no text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(compress(b)) for b in blocks(data)) for compress in self.pair)
        return (good - bad) / len(data), (good - bad) / (good + bad), good / len(data)


def dictionary_of(texts: list[str]) -> bytes:
    """A dictionary trained on the texts; their plain content where there is too little to train on."""
    samples = [block for t in texts for block in blocks(t.encode("utf-8", "surrogatepass")) if block]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on labelled rows outside the held-out fold: half for the dictionaries, half to calibrate.

    The sample has at most 2 * SAMPLE_PER_CLASS texts of at most SAMPLE_CHARS characters.
    Without labels of both classes every text scores the smoothed share of label 1.
    """
    sample = labelled_sample(docs, labels, "quality", SAMPLE_PER_CLASS, fold(HELD_OUT_FOLDS) != HELD_OUT)
    rows = sample.where((F.length("text") <= SAMPLE_CHARS) & (F.col("text") != "")).collect()
    rows.sort(key=lambda r: r.doc_id)
    good = dictionary_of(list(dict.fromkeys(r.text for r in rows if r.half == 0 and r.label == 1)))
    bad = dictionary_of(list(dict.fromkeys(r.text for r in rows if r.half == 0 and r.label == 0)))
    compressors = Compressors(good, bad)
    rest = [r for r in rows if r.half == 1]
    x = np.array([compressors.inputs(r.text) for r in rest]).reshape(-1, 3)
    return QualityModel(good, bad, Logistic(x, np.array([r.label for r in rest])))


def _with_compressors(model: QualityModel) -> tuple[QualityModel, Compressors]:
    return model, Compressors(model.good, model.bad)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) for every row, from the whole text only.

    Null counts as the empty text, which has zero inputs and so one fixed score. Rows that
    repeat a doc_id are scored one by one.
    """
    sent = send(docs.sparkSession, model)

    def run(batch):
        fitted, compressors = received(sent, _with_compressors)
        x = np.array([compressors.inputs(text) for text in batch["text"]]).reshape(-1, 3)
        return {"doc_id": batch["doc_id"], "score": fitted.calibrator.probability(x).tolist()}

    base = ids_and_text(docs)
    return map_batches(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fit outside the held-out fold, score all rows."""
    scored = quality_scores(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        (fold(HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
