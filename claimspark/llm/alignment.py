"""Cross-tokenizer alignment: groups of tokens of two tokenizers between common byte offsets.

Each tokenizer's cumulative byte ends of a text go into a dictionary from end to token index. The
ends that both dictionaries hold, sorted, cut both id lists into groups; a group's links are its
pairs of an A token and a B token that end together.

How often a pair of ids is linked is counted over the corpus. Documents are tokenised once, in
blocks; a block's written row holds its links as packed numbers and its distinct id pairs with
counts. Only distinct pairs of a block are shuffled: to be summed, and back to their block with
the sum and with whether it is the highest of its B id. So a pair that fills a third of the
corpus is one row of each block, and no table of pairs is broadcast or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, groups, pieces

BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents of a block, and bytes of their texts, at most; a longer text is a block by itself.
BLOCK_DOCS, BLOCK_BYTES = 2000, 8 << 20


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """How many tokens of A, and of B, come up to each byte offset where tokens of both end."""
    a_index, b_index = (dict(zip(ends.tolist(), range(1, len(ends) + 1), strict=True)) for ends in (a_ends, b_ends))
    cuts = sorted(a_index.keys() & b_index.keys())
    return [a_index[end] for end in cuts], [b_index[end] for end in cuts]


class Aligner:
    """The two tokenizers of a Python worker, with the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = bpe.load_plain(byte_path), pieces.load(piece_path)
        self.a_raw, self.b_raw = self.a.token_bytes(), self.b.raw
        self.a_size, self.b_size = (np.array([len(x) for x in raw], np.int64) for raw in (self.a_raw, self.b_raw))
        a_name, b_name = (list(map(str, range(len(raw)))) for raw in (self.a_raw, self.b_raw))
        #: Ids as text with what follows them: A inside a slice and at its end, B inside and at its end.
        self.signs = np.array([n + sign for names, signs in ((a_name, ",|"), (b_name, ",;")) for sign in signs for n in names], object)
        #: Tokenizers that keep all bytes of a text, but for the sign that B writes for a space.
        self.keeping = isinstance(self.a, bpe.ByteRanks) and bool(self.b.bytes)

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids of both; none where a tokenizer's bytes are not the text's."""
        first, (second, _) = self.a.ids_after_space(texts), self.b.encode(texts, checked=False)
        none = np.zeros(0, np.uint32)
        for text, x, y in zip(texts, first, second, strict=True):
            a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            if self.keeping:
                same = text and pieces.SPACE not in text
            else:
                raw = (" " + text).encode()
                same = text and b"".join(map(self.a_raw.__getitem__, a.tolist())) == raw == b"".join(map(self.b_raw.__getitem__, b.tolist()))
            yield (a, b) if same else (none, none)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
        """The groups as `a1,a2|b1;a3|b2,b3`, and their links as A id << 32 | B id.

        Tokens hold bytes, so of a group's tokens only the last two end together.
        """
        to_a, to_b = (np.array(x, np.int64) for x in common_ends(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])))
        if not len(to_a):
            return "", np.zeros(0, np.int64)
        n_a, n_b, a, b = len(self.a_raw), len(self.b_raw), a.astype(np.int64), b.astype(np.int64)
        links = a[to_a - 1] << 32 | b[to_b - 1]
        # a slice's A tokens stand behind the B tokens of all slices before, its B tokens behind its A tokens
        written = np.empty(len(a) + len(b), np.int64)
        sign_a, sign_b = a.copy(), 2 * n_a + b
        sign_a[to_a - 1] += n_a
        sign_b[to_b - 1] += n_b
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        written[np.arange(len(a)) + np.repeat(to_b - of_b, of_a)] = sign_a
        written[np.arange(len(b)) + np.repeat(to_a, of_b)] = sign_b
        return "".join(self.signs[written].tolist())[:-1], links


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _block(rows: list[tuple], block: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A row: ids and sizes of documents, their links as numbers of pairs, and the distinct pairs with counts."""
    ids, sizes, shas, links = zip(*rows, strict=True)
    flat = np.concatenate(links)
    codes, found = pd.factorize(flat)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, number = found[order], place[codes]
    counts = np.bincount(number, minlength=len(pairs))
    n_links = [len(x) for x in links]
    column = lambda v, t: pa.array([v], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block]),
            column(list(ids), id_type),
            *(column([s[i] for s in sizes], pa.int64()) for i in range(3)),
            column(n_links, pa.int64()),
            column(list(shas), pa.string()),
            pa.array([groups.squeeze(number.astype(np.uint32))], pa.binary()),
            column(pairs, pa.int64()),
            column(counts, pa.int64()),
        ],
        names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "shas", "links", "pairs", "counts"],
    )


def _aligned(paths: tuple[str, str], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(paths)
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0
        for part in common.slices(batches, 128):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, text, (a, b) in zip(part.column(0).to_pylist(), texts, aligner.tokens(texts), strict=True):
                size = len(text)
                if rows and (len(rows) >= BLOCK_DOCS or held + size > BLOCK_BYTES):
                    yield _block(rows, block, id_type)
                    rows, held, block = [], 0, block + 1
                made, links = aligner.groups(a, b)
                rows.append((key, (len(a), len(b), len(links)), hashlib.sha256(made.encode()).hexdigest() if len(a) else "", links))
                held += size
        if rows:
            yield _block(rows, block, id_type)

    return run


_OUT = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks whose pairs have come back as (pair, sum, whether it is a B id's highest)."""
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda name, r=r: batch.column(batch.schema.get_field_index(name))[r]
            of_docs = [get(c).values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "shas")]
            n_links = np.asarray(of_docs[4])
            number = groups.expand(get("links").as_py(), np.uint32)
            known = get("known").values
            n, sums, best = (np.zeros(0, np.int64),) * 3
            if known is not None and len(known):
                order = np.argsort(known.field("pair").to_numpy())  # numbers of pairs follow their order
                sums, best = known.field("sum").to_numpy()[order], known.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(n_links)))
            total = np.concatenate(([0], np.cumsum(sums[number] if len(number) else n)))
            high = np.concatenate(([0], np.cumsum(best[number] if len(number) else n)))
            take = lambda x, edges=edges: pa.array(x[edges[1:]] - x[edges[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*of_docs[:5], take(high), take(total), of_docs[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def blocks_of(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """The written blocks of documents with their links; one tokenising pass."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = f"block long, ids array<{kind.simpleString()}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, links binary, pairs array<long>, counts array<long>"
    return common.materialize(common.map_batches(docs.select(id_col, text_col), _aligned((byte_path, piece_path), to_arrow_type(kind)), schema), "links")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold an A id and a B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    return each.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")


def align_documents(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs, the corpus table of pairs a, b, n).

    Columns: id, n_a and n_b tokens, n_groups, n_links, n_best (links whose pair is the most
    frequent of its B id, ties included), count_sum (of the links' pairs), groups_sha256. A is a
    byte-level tokenizer of a space and the text, B a piece model of the text; strings of special
    tokens are plain text. Null or empty text, and text whose bytes one of the two does not give
    back (such as one that holds U+2581), has no tokens: zeros and ''. Null and repeated ids each
    give their own row; other columns are ignored; an empty table gives empty results. A very long
    text is tokenised by one task and is a block by itself; memory is its size many times over.
    """
    from .token_counts import tokenizer_path

    paths = byte_tokenizer or tokenizer_path(BYTE_TOKENIZER), piece_model or pieces.model_path(PIECE_MODEL)
    blocks = blocks_of(docs, *paths, id_col, text_col)
    counts = common.materialize(pair_counts(blocks), "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("_most"))
    pair = F.shiftleft(F.col("a"), 32).bitwiseOR(F.col("b"))
    known = counts.join(highest, "b").select(pair.alias("pair"), F.col("n").alias("sum"), (F.col("n") == F.col("_most")).alias("best"))
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    back = asked.join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "sum", "best")).alias("known"))  # a block's distinct pairs: bounded by its bytes
    whole = blocks.drop("pairs", "counts").join(back, "block", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = common.map_batches(whole, _finished, _OUT.format(kind=kind)).withColumnRenamed("doc_id", id_col)
    return out, counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(common.read_table(spark, sf_dir, "documents"))[0]


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
