"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text's encoding is the best path through the lattice of vocabulary pieces.
A state is (position, last piece); a step appends a piece. For a unigram
model a step weighs the piece's score. For a BPE model a step weighs 0 if
BPE, run on the two neighbouring pieces alone, would leave them as they are,
and minus infinity otherwise: exactly one path has a finite weight, and it is
the merge order's result (merges inside two neighbours don't depend on what
lies around them, so an encoding is right if and only if each neighbouring
pair is).

Where no vocabulary piece joins two characters the lattice has a cut: every
path passes it. Between cuts lie short words, whose paths are remembered.

A giant document is split into chunks. Each chunk, wherever it runs, turns
into a matrix from entry states (pieces that may reach over its start) to
exit states (pieces that reach over its end) under max and plus. Matrices are
combined associatively: per block of chunks, over a document's blocks, and
back down to each chunk, which learns its own entry and exit state and then
traces its pieces back independently. The ids don't depend on chunk sizes
(unigram models: up to paths of equal weight).

Edge cases: null and empty texts have no ids; unknown characters turn into
byte pieces where the model has them, else runs of them into the unknown id;
a literal U+2581 is a space to the model, so such a text decodes with a space;
repeated rows are encoded one by one; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemill.llm.textbuf import spread, table, text_batches
from tastemill.session import materialize

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK_OF_CHUNKS = 65536, 64
SPACE = "▁"
START = -1                       # the state before the first piece
MEMO_WORDS = 400_000             # remembered words per Python worker, the first ones it meets


def load_model(path: str) -> dict:
    """The tables that encoding needs, as plain values for a broadcast (a
    vocabulary is of fixed size). Read on the driver; executors need no file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        raw = f.read()
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    norm = proto.normalizer_spec
    kinds = {p.type for p in proto.pieces}
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix \
            or 4 in kinds or 5 in kinds or proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models that keep the text as it is")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
    names = [p.piece for p in proto.pieces]
    bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    surface = []
    for p in proto.pieces:
        surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3
                       else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode())
    unk = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
    return {"key": hashlib.sha256(raw).hexdigest(), "bpe": proto.trainer_spec.model_type == 2, "pieces": pieces, "names": names,
            "bytes": bytes_at if len(bytes_at) == 256 else None, "unk": unk, "surface": surface,
            "prefix": bool(norm.add_dummy_prefix)}


def merge_order(word: str, pieces: dict) -> list[str]:
    """BPE on a short string: merge the best-scored neighbours, leftmost
    first, until none joins into a piece."""
    parts = list(word)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            got = pieces.get(parts[i] + parts[i + 1])
            if got is not None and (best is None or got[1] > best):
                best, at = got[1], i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Neighbours(dict):
    """(piece, piece) -> whether BPE keeps the two apart, worked out once."""

    def __init__(self, tables: dict):
        super().__init__()
        self.names, self.pieces = tables["names"], tables["pieces"]

    def __missing__(self, pair):
        a, b = self.names[pair[0]], self.names[pair[1]]
        ok = self[pair] = merge_order(a + b, self.pieces) == [a, b]
        return ok


class Lattice:
    """A model's lattice on one Python worker."""

    def __init__(self, tables: dict):
        import ahocorasick

        self.t, self.bpe, self.pieces = tables, tables["bpe"], tables["pieces"]
        self.auto = ahocorasick.Automaton()
        self.longest, inside = 1, set()
        for name, (i, score) in self.pieces.items():
            if self.bpe and len(name) > 1 and merge_order(name, self.pieces) != [name]:
                continue                       # no merge order ever leaves this piece
            self.auto.add_word(name, (i, len(name), score))
            self.longest = max(self.longest, len(name))
        self.auto.make_automaton()
        for name in self.pieces:               # character pairs that some piece joins
            inside.update(zip(name, name[1:]))
        self.inside = inside
        self.chars = {n for n in self.pieces if len(n) == 1}
        strays = {c for pair in inside for c in pair} - self.chars
        self.loose = (min((s for _, s in self.pieces.values()), default=0.0) - 10.0)
        self.apart = Neighbours(tables)
        # words may be found by a plain split if pieces hold spaces at their start only and no newline
        self.plain = not strays and not any(a != SPACE and b == SPACE for a, b in inside) and not any("\n" in p for p in inside)
        self.words = Words(self)

    def fits(self, before: int, piece: int) -> bool:
        """May ``piece`` follow? Unknown characters (below START) never join."""
        return not self.bpe or before < 0 or piece < 0 or self.apart[(before, piece)]

    def cut(self, a: str, b: str) -> bool:
        return (a, b) not in self.inside

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(end, piece, length, weight) of all pieces in a text by end, with
        unknown characters as pieces of their own."""
        out = [(e + 1, i, n, 0.0 if self.bpe else s) for e, (i, n, s) in self.auto.iter(text)]
        lost = [(e + 1, -2 - ord(c), 1, 0.0 if self.bpe else self.loose) for e, c in enumerate(text) if c not in self.chars]
        return sorted(out + lost, key=lambda m: m[0]) if lost else out

    def forward(self, text: str, starts: dict, stop: int) -> dict:
        """Best weight of each state: position -> last piece -> (weight, from
        position, from piece, piece). ``starts`` gives the first states as
        position -> {piece: weight}; pieces start before ``stop``."""
        best = {p: {k: (w, None, None, k) for k, w in s.items()} for p, s in starts.items()}
        for end, piece, size, weight in self.matches(text):
            at = end - size
            if at >= stop or at not in best:
                continue
            here = best.setdefault(end, {})
            key = piece if self.bpe else 0
            for before, (w, *_) in best[at].items():
                if self.fits(before, piece) and (key not in here or w + weight > here[key][0]):
                    here[key] = (w + weight, at, before, piece)
            if not here:
                del best[end]
        return best

    def back(self, best: dict, end: int, key: int) -> list[int]:
        """Pieces of the best path to a state."""
        out = []
        while best[end][key][1] is not None:
            _, at, before, piece = best[end][key]
            out.append(piece)
            end, key = at, before
        return out[::-1]

    def word(self, w: str) -> tuple[int, ...]:
        """Pieces of a text between two cuts."""
        if self.bpe and self.chars.issuperset(w):
            # one state per position: a prefix has one encoding, hence one last piece
            size, fits = len(w), self.apart
            last, length = [None] * (size + 1), [0] * (size + 1)
            last[0] = START
            for e, (i, n, _) in self.auto.iter(w):
                e += 1
                if last[e] is None:
                    before = last[e - n]
                    if before is not None and (before < 0 or fits[before, i]):
                        last[e], length[e] = i, n
            out, at = [], size
            while at:
                out.append(last[at])
                at -= length[at]
            return tuple(out[::-1])
        best = self.forward(w, {0: {START if self.bpe else 0: 0.0}}, len(w))
        return tuple(self.back(best, len(w), max(best[len(w)], key=lambda k: best[len(w)][k][0])))

    def split(self, text: str) -> list[str]:
        """A text cut into words; their ends are cuts of the lattice."""
        out, at = [], 0
        if self.plain:
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append("\n")
                if line:
                    words = line.split(SPACE)
                    if words[0]:
                        out.append(words[0])
                    run = 0
                    for w in words[1:]:
                        if w:
                            out.append(SPACE * (run + 1) + w)
                            run = 0
                        else:
                            run += 1
                    if run:
                        out.append(SPACE * run)
            return out
        for i in range(1, len(text)):
            if self.cut(text[i - 1], text[i]):
                out.append(text[at:i])
                at = i
        return [*out, text[at:]] if text else []

    def ids(self, pieces) -> list[int]:
        """Pieces as ids: unknown characters become bytes or the unknown id."""
        out, lost = [], False
        for p in pieces:
            if p >= 0:
                out.append(p)
                lost = False
            elif self.t["bytes"]:
                out += [self.t["bytes"][b] for b in chr(-2 - p).encode("utf-8", "surrogatepass")]
            elif not lost:
                out.append(self.t["unk"])
                lost = True
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins and ends at cuts."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if self.t["bytes"] \
            else self.ids(chain.from_iterable(self.word(w) for w in self.split(text)))

    # -- chunks ---------------------------------------------------------------

    def entries(self, left: str, body: str) -> list[tuple[int, int]]:
        """States at a chunk's start: (characters that the last piece takes
        of the chunk, that piece)."""
        if not left or self.cut(left[-1], body[0]):    # at a cut, what came before doesn't matter
            return [(0, START if self.bpe else 0)]
        n = len(left)
        found = {(e - n, i if self.bpe else 0) for e, i, size, _ in self.matches(left + body[:self.longest]) if e >= n and e - size < n}
        return sorted(found)

    def ends(self, left: str, body: str, right: str) -> tuple[int | None, int | None]:
        """First and last cut of a chunk, from 0 to its length."""
        whole, n = left[-1:] + body + right[:1], len(left[-1:])
        is_cut = lambda i: not 0 < i + n < len(whole) or self.cut(whole[i + n - 1], whole[i + n])
        first = next(filter(is_cut, range(len(body) + 1)), None)
        return (first, None) if first is None else (first, next(filter(is_cut, range(len(body), -1, -1))))

    def paths(self, left: str, body: str, right: str, entry: tuple[int, int]):
        """The lattice from an entry state to the chunk's exits: the states
        up to the first cut, the words between the cuts, and the states from
        the last cut on (all in one if there's no cut)."""
        text, size = body + right[:self.longest], len(body)
        first, last = self.ends(left, body, right)
        offset, piece = entry
        if first is None:
            return self.forward(text, {offset: {piece: 0.0}}, size), None, None, None
        head = self.forward(text[:first], {offset: {piece: 0.0}}, first) if offset <= first else {}
        tail = self.forward(text[last:], {0: {START if self.bpe else 0: 0.0}}, size - last)
        return head, (first, last), tail, text

    def exits(self, states: dict, size: int, closing: bool) -> dict:
        """Exit states (characters beyond the end, last piece) and weights."""
        return {(e - size, k): s[0] for e, at in states.items() if e == size or e > size and not closing for k, s in at.items()}

    def matrix(self, left: str, body: str, right: str) -> dict:
        """Entry state -> exit state -> weight. What lies between the first
        and the last cut weighs the same on every path and is left out."""
        out, done = {}, None
        for entry in self.entries(left, body):
            head, cuts, tail, _ = self.paths(left, body, right, entry)
            if cuts is None:
                row = self.exits(head, len(body), not right)
            else:
                reach = [s[0] for s in head.get(cuts[0], {}).values()]
                if not reach:
                    continue
                if done is None:
                    done = self.exits(tail, len(body) - cuts[1], not right)
                row = {k: max(reach) + w for k, w in done.items()}
            if row:
                out[entry] = row
        return out

    def trace(self, left: str, body: str, right: str, entry: tuple[int, int], exit_: tuple[int, int]) -> list[int]:
        """Ids of the pieces that start in the chunk, between two states."""
        head, cuts, tail, text = self.paths(left, body, right, entry)
        size = len(body)
        if cuts is None:
            return self.ids(self.back(head, size + exit_[0], exit_[1]))
        first, last = cuts
        at = head[first]
        out = self.ids(self.back(head, first, max(at, key=lambda k: at[k][0])))
        out += self.encode(text[first:last])
        return out + self.ids(self.back(tail, size - last + exit_[0], exit_[1]))


class Words(dict):
    """Word -> ids, worked out once and held up to a bound."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, w: str):
        got = tuple(self.lattice.ids(self.lattice.word(w)))
        if len(w) <= 64 and len(self) < MEMO_WORDS:
            self[w] = got
        return got


def lattice(tables: dict) -> Lattice:
    """The lattice of a model, kept by the Python worker between its tasks."""
    held = sys.__dict__.setdefault("_lattice_of_worker", {})
    if held.get("key") != tables["key"] or held["type"] != Lattice.__qualname__:
        held.update(key=tables["key"], type=Lattice.__qualname__, lattice=Lattice(tables))
    return held["lattice"]


def prepared(text: str, tables: dict) -> str:
    return (SPACE if tables["prefix"] and text else "") + text.replace(" ", SPACE)


def encode_text(text: str | None, tables: dict) -> list[int]:
    return lattice(tables).encode(prepared(text, tables)) if text else []


def decode_ids(ids, tables: dict) -> str:
    surface = tables["surface"]
    got = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace")
    return got[1:] if tables["prefix"] and got[:1] == " " else got


def compose(a: dict, b: dict) -> dict:
    """Max-plus product of two matrices."""
    out: dict = {}
    for x, row in a.items():
        new: dict = {}
        for y, w in row.items():
            for z, v in b.get(y, {}).items():
                if z not in new or w + v > new[z]:
                    new[z] = w + v
        if new:
            out[x] = new
    return out


def packed(matrix: dict) -> list[tuple]:
    return [(x[0], x[1], y[0], y[1], w) for x, row in matrix.items() for y, w in row.items()]


def unpacked(rows) -> dict:
    out: dict = {}
    for r in rows:
        a, b, c, d, w = (r[k] for k in "abcdw") if isinstance(r, dict) else r
        out.setdefault((int(a), int(b)), {})[(int(c), int(d))] = float(w)
    return out


MATRIX = "array<struct<a:int,b:int,c:int,d:int,w:double>>"


def walk(matrices: list[dict], first: list, last: list) -> list[tuple]:
    """The states of one best path at every boundary of a run of matrices,
    from one of the states ``first`` to one of ``last``."""
    after = [{z: 0.0 for z in last}]
    for m in reversed(matrices):
        after.append({x: max(w + after[-1][y] for y, w in row.items() if y in after[-1])
                      for x, row in m.items() if any(y in after[-1] for y in row)})
    after.reverse()
    path = [max(sorted(x for x in first if x in after[0]), key=after[0].__getitem__)]
    for m, rest in zip(matrices, after[1:]):
        row = m[path[-1]]
        path.append(max(sorted(y for y in row if y in rest), key=lambda y: row[y] + rest[y]))
    return path


def last_states(matrix: dict) -> list[tuple]:
    return sorted({z for row in matrix.values() for z in row})


def scan(chunks: DataFrame) -> DataFrame:
    """``uid``, ``chunk``, ``matrix`` -> each chunk's entry and exit state."""
    blocks = chunks.select("uid", "chunk", F.floor(F.col("chunk") / BLOCK_OF_CHUNKS).cast("int").alias("block"), "matrix")

    def product(key, frame: pd.DataFrame) -> pd.DataFrame:
        m = None
        for rows in frame.sort_values("chunk")["matrix"]:
            m = unpacked(rows) if m is None else compose(m, unpacked(rows))
        return pd.DataFrame({"uid": [key[0]], "block": [key[1]], "matrix": [[dict(zip("abcdw", r)) for r in packed(m)]]})

    def steps(key, name: str, frame: pd.DataFrame, first: list | None, last: list | None) -> pd.DataFrame:
        ms = [unpacked(rows) for rows in frame["matrix"]]
        path = walk(ms, first or sorted(ms[0]), last or last_states(ms[-1]))
        return pd.DataFrame({"uid": key[0], name: frame[name].to_numpy(), "entry_at": [x[0] for x in path[:-1]], "entry_piece": [x[1] for x in path[:-1]],
                             "exit_at": [x[0] for x in path[1:]], "exit_piece": [x[1] for x in path[1:]]})

    def over_blocks(key, frame: pd.DataFrame) -> pd.DataFrame:
        return steps(key, "block", frame.sort_values("block"), None, None)

    def within(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        end = right.iloc[0]
        state = lambda side: [(int(end[side + "_at"]), int(end[side + "_piece"]))]
        return steps(key, "chunk", left.sort_values("chunk"), state("entry"), state("exit"))

    products = blocks.groupBy("uid", "block").applyInPandas(product, f"uid bigint, block int, matrix {MATRIX}")
    states = "entry_at int, entry_piece int, exit_at int, exit_piece int"
    ends = products.groupBy("uid").applyInPandas(over_blocks, f"uid bigint, block int, {states}")
    return (blocks.groupBy("uid", "block").cogroup(ends.groupBy("uid", "block"))
            .applyInPandas(within, f"uid bigint, chunk int, {states}"))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", out: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with an int array ``out``; a column of that name is replaced.
    Texts of over ``chunk`` characters go through the scan."""
    spark = docs.sparkSession
    text_batches(spark)
    tables = load_model(model_path)
    held = spark.sparkContext.broadcast(tables)
    docs = docs.drop(out) if out != text_col else docs
    giant = F.coalesce(F.length(text_col), F.lit(0)) > chunk

    @arrow_udf("array<int>")
    def whole(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            lists = [encode_text(t, held.value) for t in col.to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(off[-1]))
            yield pa.ListArray.from_arrays(pa.array(off), pa.array(flat))

    short = docs.where(~giant).withColumn(out, whole.asNondeterministic()(F.col(text_col)))
    # written once: the texts that are split and the rows that get the ids must be numbered alike
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    large = materialize(docs.where(giant).select(whole_row, F.monotonically_increasing_id().alias("uid")), "giants")
    longest = max((len(n) for n in tables["pieces"]), default=1)
    chunk = max(chunk, 2 * longest)      # a piece reaches into the next chunk at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = prepared(text, held.value)
                at = range(0, len(text), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()),
                     pa.array([text[max(0, i - longest):i] for i in at], pa.string()), pa.array([text[i:i + chunk] for i in at], pa.string()),
                     pa.array([text[i + chunk:i + chunk + longest] for i in at], pa.string())], names=["uid", "chunk", "left", "body", "right"])

    @arrow_udf(MATRIX)
    def matrices(left: pa.Array, body: pa.Array, right: pa.Array) -> pa.Array:
        at = lattice(held.value)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("d", pa.int32()), ("w", pa.float64())]))
        return pa.array([[dict(zip("abcdw", r)) for r in packed(at.matrix(*x))] for x in zip(left.to_pylist(), body.to_pylist(), right.to_pylist())], type=kind)

    @arrow_udf("array<int>")
    def traced(left: pa.Array, body: pa.Array, right: pa.Array, ea: pa.Array, ep: pa.Array, xa: pa.Array, xp: pa.Array) -> pa.Array:
        at = lattice(held.value)
        return pa.array([at.trace(a, b, c, (d, e), (f, g)) for a, b, c, d, e, f, g in zip(*[x.to_pylist() for x in (left, body, right, ea, ep, xa, xp)])],
                        type=pa.list_(pa.int32()))

    parts = (large.select("uid", F.col(f"row.`{text_col}`").alias("text"))
             .mapInArrow(split, "uid bigint, chunk int, left string, body string, right string").repartition("uid", "chunk"))
    text_cols = [F.col("left"), F.col("body"), F.col("right")]
    chunks = materialize(parts.withColumn("matrix", matrices.asNondeterministic()(*text_cols)), "chunks")
    states = scan(chunks)
    done = chunks.drop("matrix").join(states, ["uid", "chunk"]).withColumn(
        "part", traced.asNondeterministic()(*text_cols, *[F.col(c) for c in ("entry_at", "entry_piece", "exit_at", "exit_piece")]))
    whole_ids = done.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    whole_ids = whole_ids.select("uid", F.flatten(F.col("parts.part")).alias("found"))
    joined = large.join(whole_ids, "uid").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != out], F.col("found").alias(out))
    return short.select(*[f"`{c}`" for c in docs.columns if c != out], out).unionByName(joined)


def decode(rows: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``out``; null ids give ''."""
    held = rows.sparkSession.sparkContext.broadcast(load_model(model_path))
    text_batches(rows.sparkSession)

    @arrow_udf("string")
    def run(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in ids:
            out_ = []
            for x in col:
                out_.append(decode_ids(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else [], held.value))
            yield pa.array(out_, type=pa.string())

    return rows.withColumn(out, run.asNondeterministic()(F.col(ids_col)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = decode(encode(docs))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("round_trip"), "ids")
