"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text becomes blanks-as-marks units; no piece spans two units, so each is merged on its own by an agenda: the best-scored adjacent
pair first, the leftmost among equals. A candidate merge taken from the agenda is skipped if a keyed hash of (seed, document, place of the
unit, place in the unit, merged piece) falls below the dropout rate, so every occurrence of a word has draws of its own and every run cuts it alike.

The agenda depends on the draws only through the merges that it skips. For every unit met again there is a tree: a node is the set of merges skipped
so far and holds the merges tested after the last of them and the cut if none of those is skipped; a skip leads to a child. An
occurrence follows its draws down the tree, nodes are made when reached again, and the tree is a cache: it changes no result.
With dropout 0 the ids are those of the plain encoder. What has no piece is written as byte pieces; a mark character that is
part of the text itself is too, so every text decodes to itself.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.llm.common import returning, small_batches, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Nodes and units met once that are kept between blocks of about _BLOCK_CHARS characters, some 130 MB; longest unit and number of rows that matrices take; most skips of a node.
_KEPT_NODES, _BLOCK_CHARS = 250_000, 1 << 20
_LONGEST_ROW, _ROWS, _DEEPEST = 32, 8192, 6
#: Occurrences whose draws are made at a time.
_DRAWN = 1 << 17
_NONE, _GONE, _BYTES = 1 << 30, -1, -2
#: Mark of a child that was reached once and has no node yet.
_SEEN = -2


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and the segmentation of texts."""

    def __init__(self, model: bytes, dropout: float, seed: int):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes_of = [int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else None for i in range(sp.get_piece_size())]
        self.byte_id = {b: i for i, b in enumerate(self.bytes_of) if b is not None}
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces")
        self.raw = [bytes([b]) if b is not None else b"" for b in self.bytes_of]
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces span words; units cannot be cut at blanks")
        # Line feeds that are part of no longer piece end a unit too.
        alone = not any("\n" in p for p in self.ids if len(p) > 1)
        self.units = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.dropout, self.seed = dropout, seed
        self.limit = int(min(max(dropout, 0.0), 1.0) * (1 << 64))
        self.variants = 1 << 64 if dropout > 0 else 1  # draws that tell occurrences apart
        self.limit_word = np.uint64(min(self.limit, _ALL))
        self.forget()
        self.of_char = np.full(0x110000, _BYTES, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.full(sp.get_piece_size(), _NONE, np.int32)
        splits: dict[int, int] = {}
        for piece, i in self.ids.items():
            self.rank[i] = order[self.scores[piece]]
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    splits[a << 20 | b] = i
        self.pairs = np.array(sorted(splits), np.int64)
        self.made = np.array([splits[p] for p in self.pairs.tolist()], np.int32)

    def forget(self) -> None:
        """Empty the trees. A node is a place in the lists; its tested merges are a run of places in the arrays."""
        self.root: dict[str, int] = {}
        self.seen: set[str] = set()
        self.unit_of: list[str] = []
        self.skipped: list[tuple[int, ...]] = []
        self.cuts: list[bytes] = []
        self.first, self.tests = _Column(np.int64), _Column(np.int64)
        self.code, self.child, self.owner = _Column(np.uint64), _Column(np.int32), _Column(np.int32)

    def merge(self, unit: str, draw: int) -> list[int]:
        """Ids of one unit by the agenda; ``draw`` is that of the occurrence."""
        symbols = list(unit)
        n = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores, agenda = self.scores, []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                score = scores.get(symbols[left] + symbols[right])
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or following[left] != right or len(a) + len(b) != size:
                continue  # one side has been merged since
            if self.limit and _mixed(draw ^ (left << 32) ^ self.ids[a + b]) < self.limit:
                continue
            symbols[left], symbols[right] = a + b, ""
            after = following[left] = following[right]
            if after < n:
                before[after] = left
            offer(before[left], left)
            offer(left, after)
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else self.spelled(s)
        return out

    def spelled(self, char: str) -> list[int]:
        return [self.byte_id[x] for x in (MARK if char == _TEXT_MARK else char).encode("utf-8", "surrogatepass")]

    def merge_many(self, units: list[str], draw: int | np.ndarray = 0) -> list[bytes]:
        """Packed ids of many units, with one draw or one for each."""
        return self._agenda(units, np.broadcast_to(np.asarray(draw, np.uint64), len(units)), None)[0]

    def _agenda(self, units: list[str], draws: np.ndarray | None, skips: np.ndarray | None):
        """Packed ids of many units, and the merges tested: the same agenda, one candidate of every unit at a time.

        Skipped is what ``draws`` says, or else the merges of ``skips`` (a row for each unit). The tests are a list of (rows, codes,
        which were skipped), one entry a step; a code is place and piece.

        A row of the matrices is a unit. ``rank`` holds for every symbol the order of its merge with the following symbol, or NONE; the
        least, leftmost one is what the agenda would give next.
        """
        n = np.fromiter(map(len, units), np.int64, len(units))
        rows, width = len(units), int(n.max())
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < n[:, None]
        sym = np.full((rows, width + 1), _GONE, np.int32)
        sym[:, :width][inside] = self.of_char[code]
        chars = np.zeros((rows, width), np.uint32)
        chars[inside] = code
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1))
        into = np.full((rows, width + 1), -1, np.int32)
        into[:, :width] = self.joined(sym[:, :-1], sym[:, 1:])
        rank = np.where(into >= 0, self.rank[into], _NONE)
        live = np.arange(rows)
        tested = []
        while len(live):
            left = (rank if len(live) == rows else rank[live]).argmin(1)
            found = rank[live, left] < _NONE
            live, left = live[found], left[found]
            piece = into[live, left]
            row = live
            code = (left.astype(np.uint64) << np.uint64(32)) ^ piece.astype(np.uint64)
            if draws is not None:
                skip = _mixed_many(draws[row] ^ code) < self.limit_word
            else:
                skip = (skips[row] == code[:, None]).any(1)
                tested.append((row, code, skip))
            if skip.any():
                rank[row[skip], left[skip]] = _NONE
                row, left, piece = row[~skip], left[~skip], piece[~skip]
            right = after[row, left]
            beyond = after[row, right]
            sym[row, left], sym[row, right] = piece, _GONE
            rank[row, right] = _NONE
            after[row, left] = beyond
            has = beyond < width
            before[row[has], beyond[has]] = left[has]
            self._offer(row, left, beyond, sym, into, rank)
            back = before[row, left]
            has = back >= 0
            self._offer(row[has], back[has], left[has], sym, into, rank)
        return self._packed(sym[:, :width], chars), tested

    def _offer(self, row, left, right, sym, into, rank) -> None:
        piece = self.joined(sym[row, left], sym[row, np.minimum(right, sym.shape[1] - 1)])
        into[row, left] = piece
        rank[row, left] = np.where(piece >= 0, self.rank[piece], _NONE)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        pair = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == pair), self.made[at], -1)

    def _packed(self, sym: np.ndarray, chars: np.ndarray) -> list[bytes]:
        stays = sym != _GONE
        ends = np.cumsum(stays.sum(1))
        ids = sym[stays]
        odd = np.nonzero((sym == _BYTES).any(1))[0]
        flat = ids.astype(np.int32).tobytes()
        starts = np.concatenate(([0], ends[:-1])) * 4
        out = [flat[s:e] for s, e in zip(starts.tolist(), (ends * 4).tolist())]
        for r in odd.tolist():  # symbols without a piece become those of their bytes
            parts: list[int] = []
            for i, c in zip(sym[r].tolist(), chars[r].tolist()):
                if i == _BYTES:
                    parts += self.spelled(chr(c))
                elif i != _GONE:
                    parts.append(i)
            out[r] = np.array(parts, np.int32).tobytes()
        return out

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of texts as packed 32-bit numbers; a key tells documents apart. The empty text has none."""
        out: list[bytes] = []
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > _BLOCK_CHARS or i + 1 == len(texts):
                out += self._encode_block(texts[start : i + 1], keys[start : i + 1])
                start, held = i + 1, 0
        return out

    def _encode_block(self, texts: list[str], keys: list[int]) -> list[bytes]:
        if len(self.cuts) > _KEPT_NODES:
            self.forget()
        elif len(self.cuts) + len(self.seen) > _KEPT_NODES:
            self.seen = set()
        cut = [self.units.findall(MARK + t.replace(MARK, _TEXT_MARK).replace(" ", MARK)) if t else [] for t in texts]
        units = list(itertools.chain.from_iterable(cut))
        ends = np.cumsum([len(u) for u in cut])
        draws = self.draws(keys, [len(u) for u in cut]) if self.limit else None
        root, seen, new = self.root, self.seen, set()
        for u in units:
            if u not in root:
                if u in seen or not self.limit:
                    new.add(u)
                else:
                    seen.add(u)
        if new:
            self._add_roots(sorted(new, key=len))
            seen -= new
        get = root.get
        node = np.array([get(u, -1) for u in units], np.int64)
        own: list[bytes] = []
        if self.limit:
            at, deep = np.nonzero(node >= 0)[0], 0
            alone = np.nonzero(node < 0)[0]  # long, or met for the first time: no tree
            alone = alone[np.argsort([len(units[i]) for i in alone.tolist()], kind="stable")]
            node[alone] = ~np.arange(len(alone))
            short = bisect.bisect_right(alone, _LONGEST_ROW, key=lambda i: len(units[i]))
            for i in range(0, short, _ROWS):
                some = alone[i : min(i + _ROWS, short)]
                own += self.merge_many([units[k] for k in some.tolist()], draws[some])
            own += [np.array(self.merge(units[i], int(draws[i])), np.int32).tobytes() for i in alone[short:].tolist()]
            while len(at):
                at, tests = self._first_skips(at, node[at], draws)
                child = self.child.held
                missing, n = np.unique(tests[child[tests] < 0], return_counts=True)
                again = (n > 1) | (child[missing] == _SEEN)
                child[missing] = _SEEN
                if deep < _DEEPEST and again.any():
                    self._add_children(missing[again])
                node[at] = self.child.held[tests]
                rest = at[node[at] < 0]  # reached for the first time, or too many ways to keep
                rest = rest[np.argsort([len(units[i]) for i in rest.tolist()], kind="stable")]
                for i in range(0, len(rest), _ROWS):
                    some = rest[i : i + _ROWS]
                    node[some] = ~np.arange(len(own), len(own) + len(some))
                    own += self.merge_many([units[k] for k in some.tolist()], draws[some])
                at = at[node[at] >= 0]
                deep += 1
        cuts = self.cuts
        found = [cuts[i] if i >= 0 else own[~i] for i in node.tolist()]
        return [b"".join(found[s:e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _first_skips(self, at: np.ndarray, node: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences at nodes: those that skip one of its tested merges, and the place of the first."""
        out_at, out_tests = [], []
        for i in range(0, len(at), _DRAWN):
            some, n = at[i : i + _DRAWN], self.tests.held[node[i : i + _DRAWN]]
            begin = np.cumsum(n) - n
            of = np.repeat(np.arange(len(some)), n)
            tests = np.arange(len(of)) + (self.first.held[node[i : i + _DRAWN]] - begin)[of]
            skip = np.nonzero(_mixed_many(draws[some][of] ^ self.code.held[tests]) < self.limit_word)[0]
            of = of[skip]
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            out_at.append(some[of[first]])
            out_tests.append(tests[skip[first]])
        return np.concatenate(out_at), np.concatenate(out_tests)

    def _add_roots(self, units: list[str]) -> None:
        """Trees of units, sorted by length. With dropout, units that matrices do not take have none."""
        short = bisect.bisect_right(units, _LONGEST_ROW, key=len)
        for i in range(0, short, _ROWS):
            some = units[i : min(i + _ROWS, short)]
            self.root.update(zip(some, self._add(some, [()] * len(some)).tolist()))
        for u in units[short:]:
            if self.limit:
                self.root[u] = -1
            else:
                self.root[u] = len(self.cuts)
                self._hold([u], [()], [np.array(self.merge(u, 0), np.int32).tobytes()], np.zeros(1, np.int64), np.zeros(0, np.uint64))

    def _add_children(self, tests: np.ndarray) -> None:
        parents = self.owner.held[tests].tolist()
        codes = self.code.held[tests].tolist()
        order = sorted(range(len(tests)), key=lambda i: len(self.unit_of[parents[i]]))
        for i in range(0, len(order), _ROWS):
            some = order[i : i + _ROWS]
            units = [self.unit_of[parents[k]] for k in some]
            self.child.held[tests[some]] = self._add(units, [(*self.skipped[parents[k]], codes[k]) for k in some])

    def _add(self, units: list[str], skipped: list[tuple[int, ...]]) -> np.ndarray:
        """New nodes; ``skipped`` are of equal length."""
        rows, deep = len(units), len(skipped[0])
        cuts, steps = self._agenda(units, None, np.array(skipped, np.uint64).reshape(rows, deep))
        after = np.zeros(rows, bool) if deep else np.ones(rows, bool)
        last = np.array([x[-1] for x in skipped], np.uint64) if deep else None
        row, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for r, c, skip in steps:
            if deep:
                after[r[c == last[r]]] = True
            new = after[r] & ~skip
            row.append(r[new])
            code.append(c[new])
        row, code = np.concatenate(row), np.concatenate(code)
        order = np.argsort(row, kind="stable")
        begin = len(self.cuts)
        self._hold(units, skipped, cuts, np.bincount(row, minlength=rows), code[order])
        return np.arange(begin, begin + rows)

    def _hold(self, units, skipped, cuts: list[bytes], n: np.ndarray, code: np.ndarray) -> None:
        begin = len(self.cuts)
        self.first.extend(len(self.code.held) + np.cumsum(n) - n)
        self.tests.extend(n)
        self.owner.extend(np.repeat(np.arange(begin, begin + len(cuts)), n))
        self.child.extend(np.full(len(code), -1))
        self.code.extend(code)
        self.unit_of += units
        self.skipped += skipped
        self.cuts += cuts

    def draws(self, keys: list[int], counts: list[int]) -> np.ndarray:
        """The draw of every unit of documents, by seed, document and place."""
        if not keys:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            of = np.array([_mixed((k ^ self.seed * 0x9E3779B97F4A7C15) & _ALL) for k in keys], np.uint64)
            place = np.concatenate([np.arange(n, dtype=np.uint64) for n in counts]) * np.uint64(0xD1B54A32D192ED03)
            return _mixed_many(np.repeat(of, counts) + place)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


class _Column:
    """A growing array."""

    def __init__(self, kind):
        self.room = np.zeros(1 << 12, kind)
        self.held = self.room[:0]

    def extend(self, more: np.ndarray) -> None:
        n = len(self.held)
        if n + len(more) > len(self.room):
            self.room = np.concatenate((self.held, np.zeros(n // 4 + 2 * len(more), self.room.dtype)))
        self.room[n : n + len(more)] = more
        self.held = self.room[: n + len(more)]


#: Stands for a mark character of the text itself while it is cut; a lone surrogate, which no text in UTF-8 holds.
_TEXT_MARK = "\ud800"
_ALL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A 64-bit mix (the finaliser of SplitMix64)."""
    x = (x + 0x9E3779B97F4A7C15) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _mixed_many(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the size of the vocabulary file


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 5, model: str = MODEL, name: str = "piece_ids") -> DataFrame:
    """``docs`` and an array of ids of ``text``; a null text counts as empty and has no ids.

    Documents are told apart by doc_id, so repeated rows are cut alike. An own column called ``name`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = _model(spark, model)

    columns = [c for c in docs.columns if c.lower() != name.lower()]
    source = docs.select(*[docs[f"`{c}`"] for c in columns])
    text = F.coalesce(source["text"].cast("string"), F.lit("")).alias(unused(source, "text_"))
    keyed = source.select("*", text, F.xxhash64(F.lit(seed), source["doc_id"].cast("string")).alias(unused(source, "key")))
    schema = source.withColumn(name, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value, dropout, seed)
        for b in batches:
            texts, keys = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist()
            ids = pieces.encode_many(texts.to_pylist(), keys)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], _lists(ids)], names=[*columns, name])

    return keyed.mapInArrow(returning(run), schema)


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decode(encoded: DataFrame, model: str = MODEL, name: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` and the text of its ids; null and empty arrays give the empty text."""
    small_batches(encoded.sparkSession)
    held = _model(encoded.sparkSession, model)
    columns = [c for c in encoded.columns if c.lower() != into.lower()]
    source = encoded.select(*[encoded[f"`{c}`"] for c in columns])
    schema = source.withColumn(into, F.lit(None).cast("string")).schema
    at = columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value, 0.0, 0)
        for b in batches:
            texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, into])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, dropout: float = 0.1, seed: int = 5, model: str = MODEL, copies: bool = False) -> DataFrame:
    """(doc_id, piece_ids, n_ids, lossless) of every row: ids with dropout, and whether decoding them gives the text.

    ``copies``: rows of one doc_id draw their skips apart, by their place in the files they are read from, so that repeats of a document are
    cut differently; a task that is run again draws as before. Otherwise rows of one doc_id are cut alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = _model(spark, model)
    keyed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.lit(seed), docs["doc_id"].cast("string"), *([F.monotonically_increasing_id()] if copies else [])).alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value, dropout, seed)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = pieces.encode_many(texts, b.column(2).to_pylist())
            same = [pieces.decode(np.frombuffer(x, np.int32)) == t for x, t in zip(ids, texts)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _lists(ids), pa.array(n), pa.array(same, pa.bool_())],
                names=["doc_id", "piece_ids", "n_ids", "lossless"],
            )

    return keyed.mapInArrow(returning(run), "doc_id long, piece_ids array<int>, n_ids long, lossless boolean")
