"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as the single token they
name are proven whole. A text is cut where no piece of the vocabulary can reach across (in front of
each run of spaces), pieces that are proven whole count one, and only the rest is merged.

Defined cases: null text counts as empty, 0 tokens; a text of spaces only, leading, double and
trailing spaces, and the space symbol itself count as the library does; null ids are kept; repeated rows
and ties are rows of their own; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Pre-tokens whose merged length a worker remembers; beyond that it starts again. Longer ones are not remembered.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


class PieceCounter(dict):
    """Pre-token (without its first space) to number of tokens."""

    def __init__(self, model_file: str):
        super().__init__()
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_file).encode
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.separable = self.proven_separable(pieces)
        self.whole = {p[1:]: 1 for i, p in enumerate(pieces) if self.separable and p[:1] == SPACE and SPACE not in p[1:] and self.encode(p[1:]) == [i]}
        self.whole[""] = 1
        self.update(self.whole)

    def proven_separable(self, pieces: list[str]) -> bool:
        """No piece reaches over a space, and spaces are neither dropped nor folded."""
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        kept = self.encode("a  b ") == self.encode("a") + self.encode(" b") + self.encode("a ")[len(self.encode("a")) :]
        return not crossing and kept

    def __missing__(self, word: str) -> int:
        if len(word) > REMEMBERED_CHARS:
            return len(self.encode(word))
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(self.whole)
        self[word] = n = len(self.encode(word))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.encode(text))
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        else:
            words = text.split(" ")
        return sum(map(self.__getitem__, words))


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no shuffle."""

    def counted(batches):
        counter = _counters.get(model_file) or _counters.setdefault(model_file, PieceCounter(model_file))
        for batch in batches:
            n = []
            for k in range(0, batch.num_rows, 500):
                n += map(counter.count, batch.column(1).slice(k, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
