"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

A text starts as its characters, spaces as U+2581. All adjacent pairs that make a piece of the
vocabulary stand on an agenda; the pair of the highest score is joined first, of equal ones the
leftmost, and the pairs with its new neighbours go on the agenda. What is no piece in the end
becomes its bytes.

No merge can cross a place whose two characters stand side by side in no piece, so a text falls
apart there into stretches that are encoded by themselves: mostly words. A worker keeps the ids
of the stretches it has seen. Every stretch that is new in an Arrow batch is also given to the
sentencepiece library, ids and decoded text both; where the two differ (no case is known) the
library's ids count, and the document says how many of its stretches were so. Callers that only
need ids may leave this check out.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches that a worker keeps, and their characters at most; longer ones are taken apart again.
KEPT, SHORT = 1 << 20, 48
#: Rows of a table of stretches that are merged together.
TOGETHER = 1 << 14
_NONE = np.iinfo(np.int32).max
_BPE = 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_loaded: dict[str, MergePieces] = {}


def load(path: str) -> MergePieces:
    """The model of this Python worker for the path."""
    if path not in _loaded:
        _loaded[path] = MergePieces(path)
    return _loaded[path]


class MergePieces:
    """A merge-type model: its pieces, scores and kinds, read from the file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != _BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path} is no merge-type model that leaves texts as they are, of plain, byte and control pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.kind, self.kinds = [p.type for p in spec.pieces], kinds
        self.piece = [p.piece for p in spec.pieces]
        normal = {p.piece.replace(SPACE, " "): (p.score, i) for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.ids = {p: i for p, (_, i) in normal.items()}
        ranks = {s: r for r, s in enumerate(sorted({s for s, _ in normal.values()}, reverse=True))}
        self.rank = {p: ranks[s] for p, (s, _) in normal.items()}
        self.neighbours = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self._tabulate()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == _BYTE}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == _UNKNOWN), 0)
        self.unknown_text = (spec.trainer_spec.unk_surface or "").encode()
        #: A piece's bytes in a text.
        self.raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() if k == _NORMAL else b"" if k == _CONTROL else self.unknown_text for p, k in zip(self.piece, self.kind, strict=True)]
        crossed = any(b == " " and a != " " for a, b in self.neighbours)
        beside = {c for pair in self.neighbours for c in pair}
        #: Characters that are in no piece with others, so that stretches end before and after them.
        self.alone = "".join(c for c in map(chr, range(128)) if c != " " and c not in beside) if self.bytes else ""
        alone = re.escape(self.alone)
        self.stretches = re.compile(".+" if crossed else f" *[^ {alone}]+|[{alone}]+| +" if alone else " *[^ ]+| +", re.DOTALL).findall
        self.head = self.library.encode(self.alone[:1])
        self.seen: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def _tabulate(self) -> None:
        """Tables of numbers: a character's symbol, and of every pair of symbols that makes a piece its rank and piece."""
        size = len(self.piece)
        symbol = lambda x: self.ids.get(x, size + ord(x) if len(x) == 1 else None)
        self.symbols = np.arange(0x110000, dtype=np.int32) + np.int32(size)
        pairs = []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
            for k in range(1, len(p)):
                if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None:
                    pairs.append(((a << 21) | b, self.rank[p], i))
        pairs.sort()
        pairs.append((np.iinfo(np.int64).max, _NONE, -1))  # so that every search ends inside
        self.pairs, self.pair_rank, self.pair_piece = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols; _NONE and -1 where they make no piece or one of them is -1."""
        code = (left.astype(np.int64) << 21) | right  # negative if one is
        at = np.searchsorted(self.pairs, code)
        at[self.pairs[at] != code] = -1
        return self.pair_rank[at], self.pair_piece[at]

    def merge_all(self, stretches: list[str]) -> list[list[int]]:
        """Ids of short stretches. Their agendas are the rows of one table; each round takes every row's best pair."""
        out: list[list[int]] = [[]] * len(stretches)
        sizes = np.array([len(s) for s in stretches])
        for least, most in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, SHORT)):
            mine = np.flatnonzero((sizes > least) & (sizes <= most))
            for rows in (mine[i : i + TOGETHER] for i in range(0, len(mine), TOGETHER)):
                for i, ids in zip(rows.tolist(), self._merge_table([stretches[i] for i in rows.tolist()], most), strict=True):
                    out[i] = ids
        return out

    def _merge_table(self, stretches: list[str], width: int) -> list[list[int]]:
        points = np.frombuffer("".join(s.ljust(width, "\0") for s in stretches).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        columns, sizes = np.arange(width), np.array([len(s) for s in stretches])
        table = np.where(columns < sizes[:, None], self.symbols[points], np.int32(-1))
        agenda, pieces = np.full(table.shape, _NONE, np.int32), np.full(table.shape, -1, np.int32)
        agenda[:, :-1], pieces[:, :-1] = self._found(table[:, :-1], table[:, 1:])
        rows, part, ranks = np.arange(len(stretches)), table, agenda
        while True:
            best = ranks.argmin(axis=1)  # the leftmost of equal ones
            going = ranks[np.arange(len(rows)), best] != _NONE
            if not going.all():
                table[rows] = part
                rows, best, part, ranks, pieces = rows[going], best[going], part[going], ranks[going], pieces[going]
            if not len(rows):
                break
            here = np.arange(len(rows))
            made = pieces[here, best]
            shift = columns[:-1] > best[:, None]
            for held in (part, ranks, pieces):
                np.copyto(held[:, :-1], held[:, 1:].copy(), where=shift)
            part[:, -1], ranks[:, -1], pieces[:, -1] = -1, _NONE, -1
            part[here, best] = made
            after = np.where(best + 1 < width, part[here, np.minimum(best + 1, width - 1)], -1)
            ranks[here, best], pieces[here, best] = self._found(made, after)
            first = np.flatnonzero(best)
            at = best[first] - 1
            ranks[first, at], pieces[first, at] = self._found(part[first, at], made[first])
        found = table >= 0
        flat, ends = table[found].tolist(), np.cumsum(found.sum(axis=1)).tolist()
        whole = ~(table >= len(self.piece)).any(axis=1)
        out, start = [], 0
        for ok, end, stretch in zip(whole.tolist(), ends, stretches, strict=True):
            out.append(flat[start:end] if ok else self._spelled(flat[start:end]))
            start = end
        return out

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Symbols that are no pieces become their bytes, or the unknown piece once for a row of them."""
        out: list[int] = []
        for n in symbols:
            if n < len(self.piece):
                out.append(n)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(n - len(self.piece)).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def merge(self, text: str) -> list[int]:
        """Ids of one stretch of any length. The agenda is a heap of score rank and place of a pair as one number."""
        rank, chars = self.rank, list(text)
        after = array("q", range(1, len(chars) + 1))
        before = array("q", range(-1, len(chars) - 1))
        end = len(chars)
        agenda = [(r << 40) | i for i in range(end - 1) if (r := rank.get(chars[i] + chars[i + 1])) is not None]
        heapq.heapify(agenda)
        place = (1 << 40) - 1
        while agenda:
            top = heapq.heappop(agenda)
            i = top & place
            if not chars[i] or (j := after[i]) == end or rank.get(chars[i] + chars[j]) != top >> 40:
                continue  # one of the two has been joined to another
            chars[i] += chars[j]
            chars[j] = ""
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get(chars[i] + chars[k])) is not None:
                    heapq.heappush(agenda, (r << 40) | i)
            h = before[i]
            if h >= 0 and (r := rank.get(chars[h] + chars[i])) is not None:
                heapq.heappush(agenda, (r << 40) | h)
        return self._spelled([self.ids.get(c, len(self.piece) + ord(c[0])) for c in chars if c])

    def apart(self, stretch: str) -> list[str]:
        """Cuts a stretch wherever two characters are side by side in no piece."""
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.neighbours] if self.bytes else []
        return [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)]

    def _made(self, stretches: list[str], checked: bool) -> list[list[int]]:
        """Ids of new stretches; if checked, each compared with the library's, and what they decode to in a row."""
        made = self.merge_all(stretches)
        for i, s in enumerate(stretches):
            if len(s) > SHORT:
                parts = self.apart(s)
                short = iter(self.merge_all([p for p in parts if len(p) <= SHORT]))
                made[i] = [n for p in parts for n in (next(short) if len(p) <= SHORT else self.merge(p))]
        if not checked:
            return made
        # a stretch without the first space is asked for after a character that stands alone
        inner = [not s.startswith(self.prefix) for s in stretches]
        asked = [i for i, s in enumerate(stretches) if s != self.prefix]
        known = self.library.encode([self.alone[:1] + stretches[i] if inner[i] else stretches[i][len(self.prefix) :] for i in asked], num_threads=1)
        known = [ids[len(self.head) :] if inner[i] else ids for i, ids in zip(asked, known, strict=True)]
        row = [n for ids in known for n in ids]
        alike = self.decode(row) == self.library.decode(row)
        for i, ids in zip(asked, known, strict=True):
            if made[i] != ids or not alike and self.decode(ids) != self.library.decode(ids):
                made[i] = ids
                self.differing.add(stretches[i])
        return made

    def encode(self, texts: list[str], checked: bool = True) -> tuple[list[bytes], list[int]]:
        """Of each text its ids as native unsigned 32-bit numbers, and how many stretches the library corrected."""
        cut = [self.stretches(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.seen) > KEPT:
            self.seen.clear()
        new = list({s for words in cut for s in words} - self.seen.keys())
        made = {s: array("I", ids).tobytes() for s, ids in zip(new, self._made(new, checked), strict=True)} if new else {}
        long = {s: ids for s, ids in made.items() if len(s) > SHORT}
        self.seen.update(made)
        out = [b"".join(map(self.seen.__getitem__, words)) for words in cut]
        for s in long:
            del self.seen[s]
        corrected = [sum(s in self.differing for s in words) for words in cut] if self.differing else [0] * len(cut)
        return out, corrected

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8, one U+FFFD for each byte that fits nowhere; the first space goes if texts get one."""
        raw, kind = self.raw, self.kind
        whole = b"".join(map(raw.__getitem__, ids))
        if self.prefix:
            first = next((i for i in ids if kind[i] != _CONTROL), None)
            if first is not None and kind[first] == _NORMAL and raw[first][:1] == b" ":
                whole = whole[1:]
        try:
            if _CONTROL not in self.kinds or not any(kind[i] == _CONTROL for i in ids):
                return whole.decode()
        except UnicodeDecodeError:
            pass
        return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        """As decode, with each run of byte pieces by itself."""
        out, run = "", b""
        leading = bool(self.prefix)
        for i in ids:
            if self.kind[i] == _BYTE:
                run += self.raw[i]
                continue
            out, run = out + _with_marks(run), b""
            text = self.raw[i].decode()
            if leading and not out and self.kind[i] != _CONTROL:
                leading, text = False, text.removeprefix(" ") if self.kind[i] == _NORMAL else text
            out += text
        return out + _with_marks(run)


def _with_marks(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in (1, 2, 3, 4) if _is_char(raw[at : at + n])), 0)
        out.append(raw[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids array<int>, decoded string, n_corrected long.

    ids are those of the sentencepiece library without begin or end, decoded is their text.
    Null text counts as empty: no ids, and "" decoded. Null and repeated ids each give their own
    row; other columns are ignored; an empty table gives an empty result. Work: one pass without
    a shuffle. Memory: a batch's texts, and of a very long text the longest stretch of characters
    that each stand beside their neighbour in some piece (about 150 bytes a character).
    """
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for part in common.slices(batches, 256):
            ids, corrected = pieces.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = np.frombuffer(b"".join(ids), np.int32)
            decoded = [pieces.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string()), pa.array(corrected, pa.int64())], names=["doc_id", "ids", "decoded", "n_corrected"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = common.map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, ids array<int>, decoded string, n_corrected long")
    return made.withColumnRenamed("doc_id", id_col)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(common.read_table(spark, sf_dir, "documents"))
    decimal = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "n_corrected")


QUERIES = {"op13_pieces": op13_pieces}
ORACLES: dict[str, str] = {}
