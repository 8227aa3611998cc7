"""Token counts by count-only Viterbi over a unigram vocabulary.

The vocabulary: no unigram model is on this machine, and none is trained. Pieces are those of a
public vocabulary, whose order is that of falling frequency; the k-th of n pieces gets Zipf's
probability 1 / (k (1 + 1/2 + ... + 1/n)), and its score is the logarithm. So counts are exactly
those that a unigram tokenizer with these pieces and scores gives (tests hold every document
against one), and not those of the byte-pair model that the pieces come from (the README has
figures). `load` takes scores from the file instead where a model is a unigram one.

Aho-Corasick enumerates the vocabulary's matches in a chunk of text; dynamic programming keeps,
for each end, the best score and its piece count only, and no more ends than the longest piece
reaches back. Ties go as in the unigram tokenizer: a later candidate must score strictly more, and
candidates come by their start, so the earliest start (the longest piece) wins. A character no
piece matches alone may be an unknown, scored ten below the lowest score, and counts one token per
UTF-8 byte. No piece holds a line feed or a space mark after another character, so a text is cut
there and equal short chunks are solved once. The automaton and the solved chunks, a bounded number of
bounded length, are kept by the Python worker.

A null or empty text has 0 tokens. Long texts without spaces take memory for their characters
only. Each row is counted on its own, repeated rows too; null ids are kept, an empty table gives no
rows, and other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
CHUNKS, CHUNK_CHARS = 300_000, 48
UNIGRAM = 1  # a model's type in its file
UNKNOWN = 10.0


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> dict[str, float]:
    """Normal pieces (no control, unknown or byte pieces) and their scores: a unigram model's own,
    else Zipf's by the order of the vocabulary."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    sp = SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if model.trainer_spec.model_type == UNIGRAM:
        return {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    return zipf([sp.id_to_piece(i) for i in ids])


def zipf(pieces: list[str]) -> dict[str, float]:
    total = math.log(sum(1 / k for k in range(1, len(pieces) + 1)))
    return {p: -math.log(k) - total for k, p in enumerate(pieces, 1)}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses the places where texts are cut")
        self.find = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN
        self.reach = max(map(len, pieces)) + 1
        self.cache: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Pieces of the best segmentation of one chunk; the state is a ring of the last ends."""
        reach = min(self.reach, len(text) + 1)
        score, count = [0.0] * reach, [0] * reach
        e = pieces = 0
        best, single = 0.0, True

        def close():
            nonlocal best, pieces
            if not single:
                v = score[(e - 1) % reach] + self.unknown
                if best is None or v > best:
                    best, pieces = v, count[(e - 1) % reach] + len(text[e - 1].encode("utf-8", "replace"))
            score[e % reach], count[e % reach] = best, pieces

        for end, (size, s) in self.find.iter(text):  # by end, from the longest, so from the earliest start
            while e <= end:
                if e:
                    close()
                e += 1
                best, single = None, False
            if size == 1:
                single = True
            k = (e - size) % reach
            v = score[k] + s
            if best is None or v > best:
                best, pieces = v, count[k] + 1
        while True:
            if e:
                close()
            if e >= len(text):
                return pieces
            e += 1
            best, single = None, False

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        chunks = CHUNK.findall(text if text[0] == MARK else MARK + text)
        try:
            return sum(map(self.cache.__getitem__, chunks))
        except KeyError:
            if len(self.cache) > CHUNKS:
                self.cache.clear()
            total = 0
            for c in chunks:
                n = self.cache.get(c)
                if n is None:
                    n = self.chunk(c)
                    if len(c) <= CHUNK_CHARS:
                        self.cache[c] = n
                total += n
            return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    path = path or vocabulary()

    def run(batches):
        for rb in common.slices(batches):
            c = counter(path)
            n = [c.count(x) if x else 0 for x in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.trimming(run), "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
