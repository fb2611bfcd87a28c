"""SentencePiece encoding and decoding with a streaming Viterbi lattice.

Each position of the text keeps one backpointer: the length of the last piece
of the best segmentation that ends there.

* Unigram models: the best segmentation has the largest sum of scores.
* BPE models: the prefix's segmentation is the one that merging would give.  A
  piece may end a prefix if merging leaves it whole and if it and the piece
  before it stay apart; exactly one piece at each position passes, so the
  lattice ends in the ids of the library.  Two pieces stay apart if no merge
  across their border comes up before the merges inside them: ``Merges.apart``
  takes the inner merges back, the latest first, and compares.

Only the last ``longest piece`` positions can start another piece.
``Pieces.segments`` looks, every ``longest`` characters, where the backpointers
of these positions meet; what lies before that boundary is final, is given out
and forgotten, so any length of text needs a window of a few pieces.

If no piece of the model has a word mark after another character, every place
before a run of marks is such a boundary too, known in advance.  ``Lattice``
advances the lattices of all new words of a batch together, position by
position, with numpy; runs of more than LONG characters stream.

Characters without a piece become their bytes.  Decoding joins the pieces,
turns marks into spaces and drops the first one.  Decoding gives the text back
unless it holds U+2581 itself, which becomes a space.  ``Pieces.load`` refuses a
model whose ids for a set of probing texts differ from the library's.

Edge cases: a null or empty text has no ids and decodes to an empty text;
repeated rows give equal rows; an empty table gives an empty result; other
columns pass by.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import ship
from terradelta.llm.runs import RunIds, groups, ragged

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Runs of more characters are segmented one by one, streaming.
LONG = 256
REMEMBERED_PAIRS = 150_000
#: Characters of texts that are encoded together, and bytes of runs remembered for the next ones: two
#: workers stand beside an executor's heap, and no memory of theirs grows with the input.
GROUP_CHARS, REMEMBERED_BYTES = 1 << 18, 32 << 20
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NEVER = np.int64(1) << 40
_PROBES = ["two words", "  two  blanks ", "tab\tline\nend", "ﬁ Å é é", "日本語 テキスト", "😀 a😀😀b", "x\0y", "<s> </s> <unk>", "a.b,c;d 1234 ABC", "ＡＢＣ　㍿", "zz zz​z"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Table:
    """Whole numbers by 64-bit keys, looked up for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = keys.astype(np.uint64) + np.uint64(1), values.astype(np.int64)
        self.levels = []
        bits = max(4, int(len(keys)).bit_length() + 2)
        while len(keys):
            slot = self._slot(keys, bits, len(self.levels))
            _, first = np.unique(slot, return_index=True)
            key_at, value_at, more = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
            key_at[slot[first]], value_at[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.levels.append((bits, key_at, value_at, more))
            keys, values, bits = keys[rest], values[rest], max(4, bits - 2)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int, level: int = 0) -> np.ndarray:
        if level == len(self.levels):
            return np.full(len(keys), default, np.int64)
        keys = keys.astype(np.uint64) + np.uint64(1) if level == 0 else keys
        bits, key_at, value_at, more = self.levels[level]
        slot = self._slot(keys, bits, level)
        hit = key_at[slot] == keys
        out = np.where(hit, value_at[slot], default)
        rest = np.flatnonzero(more[slot] & ~hit)
        if len(rest):
            out[rest] = self.get(keys[rest], default, level + 1)
        return out


class Merges:
    """What merging does with the symbols of a BPE model: its pieces, and characters that only occur in pieces."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        self.scores = scores
        self.symbols = list(scores) + sorted({c for p in scores for c in p} - scores.keys())
        self.number = {p: i for i, p in enumerate(self.symbols)}
        self.out = np.array([ids.get(p, -1) for p in self.symbols], np.int64)
        falling = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        n = len(self.symbols)
        #: order of the merge that makes a symbol, -1 for characters; its two parts; whether merging leaves it whole
        self.rank, self.left, self.right, self.whole = np.full(n, -1, np.int64), np.arange(n), np.arange(n), np.ones(n, bool)
        keys, ranks = [], []
        for i, p in enumerate(self.symbols):
            if len(p) == 1:
                continue
            parts, last = self.merged(p)
            self.whole[i] = len(parts) == 1
            self.rank[i] = falling[scores[p]]
            if self.whole[i]:
                self.left[i], self.right[i] = self.number[last[0]], self.number[last[1]]
            for k in range(1, len(p)):
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(falling[scores[p]])
        self.across = _Table(np.array(keys, np.int64), np.array(ranks, np.int64))

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, the best-scored neighbours first and the leftmost of equals; and the last merge."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether symbols a and b, side by side, are never merged across their border."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), _NEVER)  # a and b are both there for merges of a lower order
        while len(live):
            crossing = self.across.get(a * len(self.symbols) + b, int(_NEVER)) < until
            ok[live[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossing & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # of equal merges the left one comes first: it beats one across the border, and that beats one to its right
            back = ra > rb
            until = np.where(back, ra, rb + 1)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return ok


class Lattice:
    """The lattices of many short runs, advanced together."""

    def __init__(self, merges: Merges):
        self.merges = merges
        nodes: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(merges.symbols):
            if merges.whole[i]:
                at = 0
                for c in p:
                    at = nodes.setdefault((at, c), len(nodes) + 1)
                ends[at] = i
        self.steps = _Table(np.array([a << 21 | ord(c) for a, c in nodes], np.int64), np.array(list(nodes.values()), np.int64))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def segment(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each run, symbol of each piece or -1, place of its last character, code points) of non-empty runs."""
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        end = np.cumsum(size)
        first = np.repeat(end - size, size)  # of the run of each character
        stop = np.repeat(end, size)
        starts, lengths, symbols = [], [], []
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        n = 0
        while len(start):
            node = self.steps.get(node << 21 | codes[start + n], -1)
            n += 1
            symbol = np.where(node >= 0, self.ends[node], -1)
            found = symbol >= 0
            if n == 1:
                found |= True  # a character without a piece stands for itself
            starts.append(start[found])
            lengths.append(np.full(found.sum(), n))
            symbols.append(symbol[found])
            on = (node >= 0) & (start + n < stop[start])
            start, node = start[on], node[on]
        start, length, symbol = np.concatenate(starts), np.concatenate(lengths), np.concatenate(symbols)
        place = start + length - first[start]  # characters of the run up to the piece's end
        order = np.argsort(place.astype(np.int32), kind="stable")
        start, length, symbol, place = start[order], length[order], symbol[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        last, back = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            s, n, y = start[a:b], length[a:b], symbol[a:b]
            before = np.where(s > first[s], last[s - 1], -1)
            fits = np.ones(len(s), bool)
            ask = np.flatnonzero((before >= 0) & (y >= 0))
            fits[ask] = self.merges.apart(before[ask], y[ask])
            s, n, y = s[fits], n[fits], y[fits]
            last[s + n - 1], back[s + n - 1] = y, n
        ends_piece = np.zeros(len(codes), bool)
        at, low = end - 1, end - size
        while len(at):
            ends_piece[at] = True
            at = at - back[at]
            on = at >= low
            at, low = at[on], low[on]
        where = np.flatnonzero(ends_piece)
        counts = np.diff(np.searchsorted(where, np.concatenate([[0], end])))
        return counts, last[where], where, codes


class Pieces:
    """A vocabulary: text of each piece with its id and score."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_at: list[int] | None, unknown: int, bpe: bool, texts: list[bytes] | None = None):
        self.ids = {k: i for k, (i, _) in pieces.items()}
        self.scores = {k: s for k, (_, s) in pieces.items()}
        self.bytes_at, self.unknown, self.bpe, self.texts = bytes_at, unknown, bpe, texts
        self.longest = max(map(len, pieces), default=1)
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.least = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.merges = Merges(self.scores, self.ids) if bpe else None
        self.lattice = Lattice(self.merges) if bpe else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs = RunIds(self._learn, REMEMBERED_BYTES)
        self.commits = 0

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        pieces = {library.id_to_piece(i): (i, library.get_score(i)) for i in range(n) if not special[i]}
        at = {library.id_to_piece(i): i for i in range(n) if library.is_byte(i)}
        texts = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else " ⁇ ".encode() if library.is_unknown(i) else library.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        # scores of merges are falling whole numbers; those of a unigram model are log probabilities
        bpe = all(s == int(s) for _, s in pieces.values())
        m = cls(pieces, [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else None, library.unk_id(), bpe, texts)
        for probe in _PROBES:
            if m.encode(probe) != library.encode(probe):
                raise ValueError(f"{path} encodes in a way that is not rebuilt here, for instance {probe!r}")
        return m

    def fits(self, before: str, piece: str) -> bool:
        a, b = self.merges.number.get(before), self.merges.number.get(piece)
        if a is None or b is None:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = bool(self.merges.apart(np.array([a]), np.array([b]))[0])
        return ok

    def stands(self, piece: str) -> bool:
        return bool(self.merges.whole[self.merges.number[piece]])

    def segments(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of one run of text, given out as soon as they are final."""
        text, lengths, best = "", [0], [0.0]  # lengths[i]: of the last piece of the first i characters that are left
        for c in chars:
            text += c
            i = len(text)
            chosen, score = 0, 0.0
            for n in range(min(self.longest, i), 0, -1):
                piece = text[i - n :]
                known = piece in self.scores
                if not known and n > 1:
                    continue
                if self.bpe:
                    back = lengths[i - n]
                    if (n == 1 or self.stands(piece)) and (i == n or back == 0 or self.fits(text[i - n - back : i - n], piece)):
                        chosen = n
                        break
                else:
                    s = best[i - n] + (self.scores[piece] if known else self.least)
                    if not chosen or s > score:
                        chosen, score = n, s
            lengths.append(chosen)
            best.append(score)
            if len(text) % self.longest == 0 and len(text) > self.longest:
                live = set(range(len(text) - self.longest + 1, len(text) + 1))
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(last - lengths[last])
                (cut,) = live
                # the piece before the boundary stays, for the next piece to be compared with it
                cut -= lengths[cut]
                if cut > 0:
                    self.commits += 1
                    yield from self.walk(text, lengths, cut)
                    text, lengths, best = text[cut:], lengths[cut:], best[cut:]
        yield from self.walk(text, lengths, len(text))

    @staticmethod
    def walk(text: str, lengths: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(text[end - lengths[end] : end])
            end -= lengths[end]
        return out[::-1]

    def streamed(self, run: str) -> np.ndarray:
        """Ids of one run of any length."""
        out = array("I")
        for piece in self.segments(run):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes_at:
                out.extend(self.bytes_at[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return np.array(out, np.int64)

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs that are given without their first mark."""
        runs = [MARK + x for x in runs]
        counts, parts = np.zeros(len(runs), np.int64), []
        short = [i for i, x in enumerate(runs) if self.bpe and len(x) <= LONG]
        if short:
            pieces, symbols, where, codes = self.lattice.segment([runs[i] for i in short])
            ids = np.where(symbols >= 0, self.merges.out[symbols], -1)
            odd = np.flatnonzero(ids < 0)
            per_piece = np.ones(len(ids), np.int64)
            if len(odd):  # characters without a piece become their bytes
                values, inverse = np.unique(codes[where[odd]], return_inverse=True)
                raw = [[self.bytes_at[b] for b in chr(v).encode("utf-8", "surrogatepass")] if self.bytes_at else [self.unknown] for v in values.tolist()]
                per_piece[odd] = np.array([len(x) for x in raw])[inverse]
                at = np.cumsum(per_piece) - per_piece
                ids = np.repeat(ids, per_piece)
                flat, begin = np.array([y for x in raw for y in x], np.int64), np.cumsum([0] + [len(x) for x in raw])[:-1]
                ids[ragged(at[odd], per_piece[odd])] = flat[ragged(begin[inverse], per_piece[odd])]
            upto = np.concatenate([[0], np.cumsum(per_piece)])
            last = np.cumsum(pieces)
            counts[short] = upto[last] - upto[last - pieces]
            parts.append((short, ids))
        if len(short) == len(runs):
            return counts, parts[0][1]
        out = [np.zeros(0, np.int64)] * len(runs)
        if short:
            for i, x in zip(short, np.split(parts[0][1], np.cumsum(counts[short])[:-1]), strict=True):
                out[i] = x
        for i in set(range(len(runs))) - set(short):
            out[i] = self.streamed(runs[i])
            counts[i] = len(out[i])
        return counts, np.concatenate(out)

    def _cut(self, text: str | None) -> list[str]:
        """Runs without their first mark."""
        if not text:
            return []
        if not self.apart:
            return [text.replace(" ", MARK)]
        if MARK in text or "  " in text or text[-1] == " " or text[0] == " ":
            return [x[1:] for x in _RUN.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        return self.runs.take([self._cut(x) for x in texts])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def _run(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for a, b in groups(pc.utf8_length(batch.column("text")).to_pylist(), GROUP_CHARS):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                ids, n = m.encode_all(texts)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                all_ids = ids.tolist()
                back = [m.decode(all_ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_ids": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in back], pa.int64()),
                    "round_trip": pa.array([x == (y or "") for x, y in zip(back, texts, strict=True)], pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return run


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """Ids of each row of docs(doc_id, text, ...), whether they decode to the text, and checksums."""
    ship(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(model or default_model(), with_ids), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
