"""Approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors form one node. Every node has a home, a task's share of nodes; trees of random hyperplanes, fitted on a
bounded sample, put near nodes into one home, and homes do not grow with the table. The first graph is random: nodes are
dealt out into small groups several times, and the members of a group list each other. NN-descent then joins, round by
round, each node's neighbours (some of its own and some of those that list it, new ones with all, old ones with new
ones) with one another: neighbours of neighbours become candidates, and every node keeps its nearest. A round is four
joins by home: lists go to those that they name, requests to the homes of the members, vectors back, and candidates to
the nodes that they may suit. Queries walk the graph: each holds its nearest nodes so far, and rounds of joins look up
the neighbours of those not yet expanded, until all of the list are. The whole list is measured again on the original
vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, checkpoint, discard, table, written

SAMPLE, HOME, DEALS, PER_HOME = 8192, 4096, 4, 8  # PER_HOME: candidates that a home names for a node
PAIRS = 1 << 20  # distances of members at a time
STATE = "node long, home int, vec binary, w binary, whome binary, d binary, fresh binary"
MESSAGE = "home int, kind int, src int, a binary, b binary, c binary, d binary"
FORWARD, REVERSE, MEMBERS, REQUEST, REPLY, CANDIDATES = range(6)


def encode(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers of at most 1 as rows of bytes: a scale and half-precision shares of it."""
    scale = np.abs(rows).max(axis=1, keepdims=True).astype(np.float32)
    half = (rows / np.where(scale > 0, scale, 1)).astype(np.float16)
    return np.concatenate([scale.view(np.uint8), half.view(np.uint8)], axis=1)


def decode(raw: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(raw)
    return raw[:, 4:].copy().view(np.float16).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _bytes(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


class Tree:
    """A complete binary tree of hyperplanes through the medians of a sample."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.depth, dim = depth, sample.shape[1]
        self.normal = rng.standard_normal(((1 << depth) - 1, dim)).astype(np.float32)
        self.at = np.zeros((1 << depth) - 1, np.float32)
        place = np.zeros(len(sample), np.int64)
        for level in range(depth):
            side = np.einsum("ij,ij->i", sample, self.normal[place])
            for node in range((1 << level) - 1, (2 << level) - 1):
                here = side[place == node]
                self.at[node] = np.median(here) if len(here) else 0
            place = 2 * place + 1 + (side > self.at[place])

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        place = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            place = 2 * place + 1 + (np.einsum("ij,ij->i", rows, self.normal[place]) > self.at[place])
        return place - ((1 << self.depth) - 1)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in the place of random ones, from whole numbers."""
    x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _first(group: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the first so many of each group by order, group after group."""
    at = np.lexsort((order, group))
    g = group[at]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.concatenate((start, [len(g)]))))
    return at[rank < most]


def _nearest(u: np.ndarray, w: np.ndarray, d: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """Places of the nearest so many distinct w of each u, ties to the smaller w; of the same pair the one that is not fresh."""
    at = np.lexsort((fresh, w, u))
    new = np.ones(len(at), bool)
    new[1:] = (u[at][1:] != u[at][:-1]) | (w[at][1:] != w[at][:-1])
    at = at[new]
    return at[_first(u[at], d[at], most)]


class Lists:
    """The lists of a home's nodes in flat arrays, by node."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("node")
        self.node, self.vec = pdf["node"].to_numpy(), pdf["vec"].tolist()
        n = np.array([len(x) // 8 for x in pdf["w"]], np.int64)
        self.u = np.repeat(self.node, n)
        self.w, self.whome = _joined(pdf["w"], np.int64), _joined(pdf["whome"], np.int32)
        self.d, self.fresh = _joined(pdf["d"], np.float32), _joined(pdf["fresh"], np.uint8)

    def sample(self, most: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of at most so many fresh entries of each node, and of as many others."""
        order = _mixed(self.u * 31 + self.w, turn)
        fresh, old = np.flatnonzero(self.fresh), np.flatnonzero(self.fresh == 0)
        return fresh[_first(self.u[fresh], order[fresh], most)], old[_first(self.u[old], order[old], most)]


def _state(home: int, node: np.ndarray, vec: list[bytes], u: np.ndarray, w: np.ndarray, whome: np.ndarray, d: np.ndarray, fresh: np.ndarray) -> pd.DataFrame:
    """Rows of STATE; the flat lists come by node."""
    a, b = np.searchsorted(u, node), np.searchsorted(u, node, "right")
    cut = lambda v: [v[s:e].tobytes() for s, e in zip(a, b, strict=True)]
    return pd.DataFrame({"node": node, "home": np.int32(home), "vec": vec, "w": cut(w.astype(np.int64)), "whome": cut(whome.astype(np.int32)), "d": cut(d.astype(np.float32)), "fresh": cut(fresh.astype(np.uint8))})


def _messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["home", "kind", "src", "a", "b", "c", "d"]).astype({"home": "int32", "kind": "int32", "src": "int32"})


def _by_home(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1])))
    for s, e in zip(start, [*start[1:], len(to)], strict=True):
        yield int(to[order[s]]), order[s:e]


def first_graph(nodes: DataFrame, count: int, degree: int) -> DataFrame:
    """STATE of a random graph from nodes (node, home, vec); if a list can hold all others, it does."""
    groups = 1 if count <= degree + 1 else count // (degree // DEALS + 1)
    dealt = nodes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1 if groups > 1 else 0)))).withColumn("g", F.pmod(F.xxhash64("node", "deal"), F.lit(groups)))
    dealt = dealt.withColumn("block", F.floor(F.col("g") / 64))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "node"])
        rows, node, home = decode(_bytes(pdf["vec"].tolist())), pdf["node"].to_numpy(), pdf["home"].to_numpy()
        out = []
        for _, at in _by_home(pdf["g"].to_numpy()):
            x = rows[at]
            d = ((x[:, None] - x[None]) ** 2).sum(2)
            i, j = np.nonzero(~np.eye(len(at), dtype=bool))
            out.append((node[at[i]], home[at[i]], node[at[j]], home[at[j]], d[i, j]))
        u, uhome, w, whome, d = (np.concatenate([x[k] for x in out]) for k in range(5))
        return _messages([(h, CANDIDATES, -1, u[at].tobytes(), w[at].tobytes(), whome[at].astype(np.int32).tobytes(), d[at].astype(np.float32).tobytes()) for h, at in _by_home(uhome)])

    blank = nodes.select("node", "home", "vec", *[F.lit(b"").alias(c) for c in ("w", "whome", "d", "fresh")])
    return renewed(blank, dealt.groupBy("deal", "block").applyInPandas(link, MESSAGE), degree, 0, -1)


def renewed(state: DataFrame, candidates: DataFrame, degree: int, most: int, turn: int) -> DataFrame:
    """state with the candidates taken into its lists; entries that this turn's sample held are no longer fresh."""

    def take(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = Lists(pdf)
        fresh = own.fresh.copy()
        if most:
            fresh[own.sample(most, turn)[0]] = 0
        u, w = (np.concatenate([x, _joined(found[c], np.int64)]) for x, c in ((own.u, "a"), (own.w, "b")))
        whome, d = np.concatenate([own.whome, _joined(found["c"], np.int32)]), np.concatenate([own.d, _joined(found["d"], np.float32)])
        fresh = np.concatenate([fresh, np.ones(len(u) - len(fresh), np.uint8)])
        at = _nearest(u, w, d, fresh, degree)
        return _state(key[0], own.node, own.vec, u[at], w[at], whome[at], d[at], fresh[at])

    return state.groupBy("home").cogroup(candidates.groupBy("home")).applyInPandas(take, STATE)


def descend(state: DataFrame, degree: int, most: int, turn: int) -> DataFrame:
    """One round of NN-descent: the new STATE, in the place of the old."""

    def forward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = Lists(pdf), []
        for at, flag in zip(own.sample(most, turn), (1, 0), strict=True):
            mark = np.full(len(at), flag, np.uint8)
            out.append((key[0], FORWARD, key[0], own.u[at].tobytes(), own.w[at].tobytes(), own.whome[at].tobytes(), mark.tobytes()))
            out += [(h, REVERSE, key[0], own.w[at[k]].tobytes(), own.u[at[k]].tobytes(), b"", mark[k].tobytes()) for h, k in _by_home(own.whome[at])]
        return _messages(out)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ahead, behind = pdf[pdf["kind"] == FORWARD], pdf[pdf["kind"] == REVERSE]
        v, m, flag = _joined(behind["a"], np.int64), _joined(behind["b"], np.int64), _joined(behind["d"], np.uint8)
        mhome = np.repeat(behind["src"].to_numpy(), [len(x) // 8 for x in behind["a"]])
        at = _first(v * 2 + flag, _mixed(v * 31 + m, turn), most)
        v, m = (np.concatenate([_joined(ahead[c], np.int64), x[at]]) for c, x in (("a", v), ("b", m)))
        mhome, flag = np.concatenate([_joined(ahead["c"], np.int32), mhome[at]]).astype(np.int32), np.concatenate([_joined(ahead["d"], np.uint8), flag[at]])
        at = np.lexsort((1 - flag, m, v))
        once = np.ones(len(at), bool)  # of a pair that comes twice the fresh one
        once[1:] = (v[at][1:] != v[at][:-1]) | (m[at][1:] != m[at][:-1])
        at = at[once]
        at = at[np.lexsort((1 - flag[at], v[at]))]  # fresh ones first
        v, m, mhome, flag = v[at], m[at], mhome[at], flag[at]
        lonely = np.isin(v, v[flag == 1], invert=True)  # without a fresh member nothing is to be joined
        v, m, mhome, flag = v[~lonely], m[~lonely], mhome[~lonely], flag[~lonely]
        ids, one = np.unique(m, return_index=True)
        out = [(key[0], MEMBERS, key[0], v.tobytes(), m.tobytes(), mhome.tobytes(), flag.tobytes())]
        return _messages(out + [(h, REQUEST, key[0], ids[k].tobytes(), b"", b"", b"") for h, k in _by_home(mhome[one])])

    def reply(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return _messages([])
        pdf = pdf.sort_values("node")
        node, vec = pdf["node"].to_numpy(), _bytes(pdf["vec"].tolist())
        worst = np.array([np.frombuffer(x, np.float32)[-1] if len(x) == 4 * degree else np.inf for x in pdf["d"]], np.float32)
        out = []
        for src, raw in zip(asked["src"], asked["a"], strict=True):
            at = np.searchsorted(node, np.frombuffer(raw, np.int64))
            out.append((src, REPLY, key[0], raw, vec[at].tobytes(), worst[at].tobytes(), b""))
        return _messages(out)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists, got = pdf[pdf["kind"] == MEMBERS], pdf[pdf["kind"] == REPLY]
        if not len(lists) or not len(got):
            return _messages([])
        ids = _joined(got["a"], np.int64)
        homes = np.repeat(got["src"].to_numpy(), [len(x) // 8 for x in got["a"]]).astype(np.int32)
        raw, worst = _joined(got["b"], np.uint8).reshape(len(ids), -1), _joined(got["c"], np.float32)
        order = np.argsort(ids)
        ids, homes, raw, worst = ids[order], homes[order], raw[order], worst[order]
        v, m, flag = _joined(lists["a"], np.int64), np.searchsorted(ids, _joined(lists["b"], np.int64)), _joined(lists["d"], np.uint8)
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((start, [len(v)])))
        fresh = np.add.reduceat(flag.astype(np.int64), start) if len(start) else start
        order = np.argsort(size, kind="stable")  # joins of like size together
        start, size, fresh = start[order], size[order], fresh[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def shrink() -> None:
            nonlocal held
            a, b, d = (np.concatenate([x[k] for x in found]) for k in range(3))
            at = _nearest(a, b, d, np.zeros(len(a), np.uint8), PER_HOME)
            found[:] = [(a[at], b[at], d[at])]
            held = len(at)

        def name(fine: np.ndarray, d: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
            """Candidates w for u where fine, for each u the nearest of a join. u: (joins, rows), w: (joins, columns)."""
            nonlocal held
            if d.shape[2] > PER_HOME and fine.sum() > PER_HOME * u.size // 2:
                d = np.where(fine, d, np.inf)
                j = np.argpartition(d, PER_HOME - 1, axis=2)[:, :, :PER_HOME]
                d = np.take_along_axis(d, j, 2)
                c, i, k = np.nonzero(d < np.inf)
                j, d = j[c, i, k], d[c, i, k]
            else:
                c, i, j = np.nonzero(fine)
                d = d[c, i, j]
            found.append((u[c, i], w[c, j], d))
            held += len(c)

        s = 0
        while s < len(start):
            e = s + max(1, int(np.searchsorted(np.cumsum(size[s:] ** 2), PAIRS)))
            own, n, k, wide, high = start[s:e], size[s:e], fresh[s:e], int(size[s:e].max()), int(fresh[s:e].max())
            s = e
            at = np.arange(wide)
            who = m[np.minimum(own[:, None] + at, len(v) - 1)]
            real, new = at < n[:, None], at < k[:, None]
            x = decode(raw[who.ravel()]).reshape(len(own), wide, -1)
            norm, limit = (x * x).sum(2), worst[who]
            top = who[:, :high]
            d = np.maximum(norm[:, :high, None] + norm[:, None] - 2 * x[:, :high] @ x.transpose(0, 2, 1), 0)  # fresh ones with all
            pair = new[:, :high, None] & real[:, None] & (top[:, :, None] != who[:, None])
            name(pair & (d < limit[:, :high, None]), d, top, who)
            name((pair & ~new[:, None] & (d < limit[:, None])).transpose(0, 2, 1), d.transpose(0, 2, 1), who, top)
            if held > 2 * PAIRS:
                shrink()
        if not found:
            return _messages([])
        shrink()
        a, b, d = found[0]
        return _messages([(h, CANDIDATES, key[0], ids[a[k]].tobytes(), ids[b[k]].tobytes(), homes[b[k]].tobytes(), d[k].astype(np.float32).tobytes()) for h, k in _by_home(homes[a])])

    sent = state.drop("vec").withColumn("vec", F.lit(b"")).groupBy("home").applyInPandas(forward, MESSAGE)
    lists = written(sent.groupBy("home").applyInPandas(gather, MESSAGE))
    replies = state.select("node", "home", "vec", "d").groupBy("home").cogroup(lists.where(F.col("kind") == REQUEST).groupBy("home")).applyInPandas(reply, MESSAGE)
    candidates = lists.where(F.col("kind") == MEMBERS).unionByName(replies).groupBy("home").applyInPandas(join, MESSAGE)
    out = written(renewed(state, candidates, degree, most, turn))
    discard(lists)
    discard(state)
    return out


def build_graph(nodes: DataFrame, count: int, degree: int, most: int, rounds: int) -> DataFrame:
    """STATE of the graph of nodes (node, vec); rounds end early when less than one list entry in ten nodes changes."""
    every = max(1, count // SAMPLE)
    rows = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("vec").limit(3 * SAMPLE).collect() or [nodes.first()]
    sample = decode(_bytes([bytes(r["vec"]) for r in rows]))
    depth = max(0, min(int(np.ceil(np.log2(max(1, count / HOME)))), int(np.log2(max(1, len(sample) / 8)))))
    tree, parts = Tree(sample, depth, 11), max(1, -(-count // (HOME << depth)))  # leaves that would be too large fall into parts by hash

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.leaf(decode(_bytes(b.column(1).to_pylist())))
                part = _mixed(b.column(0).to_numpy(), 3) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((leaf * parts + part.astype(np.int64)).astype(np.int32))], ["node", "vec", "home"])

    placed = checkpoint(arrow_map(nodes.select("node", "vec"), place, "node long, vec binary, home int"))
    state = written(first_graph(placed, count, degree))
    for turn in range(rounds):
        state = descend(state, degree, most, turn)
        left = state.select(F.length(F.regexp_replace(F.hex("fresh"), "0", "")).alias("n")).agg(F.sum("n")).first()[0] or 0
        if left <= count // 10:
            break
    return state


def walk(queries: DataFrame, state: DataFrame, degree: int, beam: int, step: int) -> DataFrame:
    """(q, w): for each query node its list. queries: node, home, vec. Starts at the node itself."""
    names = "q long, home int, qvec binary, w binary, whome binary, d binary, done binary"

    def back(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Lists(pdf)
        return _messages([(h, REVERSE, key[0], own.w[k].tobytes(), own.u[k].tobytes(), b"", own.d[k].tobytes()) for h, k in _by_home(own.whome)])

    def both(key: tuple, pdf: pd.DataFrame, behind: pd.DataFrame) -> pd.DataFrame:
        own = Lists(pdf)
        v, w, d = _joined(behind["a"], np.int64), _joined(behind["b"], np.int64), _joined(behind["d"], np.float32)
        home = np.repeat(behind["src"].to_numpy(), [len(x) // 8 for x in behind["a"]])
        at = _first(v, d, degree)
        u, w, home, d = np.concatenate([own.u, v[at]]), np.concatenate([own.w, w[at]]), np.concatenate([own.whome, home[at]]), np.concatenate([own.d, d[at]])
        at = _nearest(u, w, d, np.zeros(len(u), np.uint8), 2 * degree)
        return _state(key[0], own.node, own.vec, u[at], w[at], home[at], d[at], np.zeros(len(at), np.uint8))

    narrow = state.drop("vec").withColumn("vec", F.lit(b""))
    near = written(narrow.groupBy("home").cogroup(narrow.groupBy("home").applyInPandas(back, MESSAGE).groupBy("home")).applyInPandas(both, STATE))
    vectors = state.select("node", "home", "vec")

    def look_up(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The neighbours of what each query asks for here, by their homes."""
        own, out = Lists(pdf), []
        for q, raw, qvec in zip(asked["src"], asked["a"], asked["b"], strict=True):
            ids = np.frombuffer(raw, np.int64)
            at = np.concatenate([np.arange(s, e) for s, e in zip(np.searchsorted(own.u, ids), np.searchsorted(own.u, ids, "right"), strict=True)] or [np.zeros(0, np.int64)])
            w, one = np.unique(own.w[at], return_index=True)
            out += [(h, q, w[k].tobytes(), qvec) for h, k in _by_home(own.whome[at][one])]
        return pd.DataFrame(out, columns=["home", "src", "a", "b"]).astype({"home": "int32", "src": "int64"})

    def measure(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Of the nodes that each query is led to here the nearest."""
        pdf = pdf.sort_values("node")
        node, vec, out = pdf["node"].to_numpy(), _bytes(pdf["vec"].tolist()) if len(pdf) else None, []
        for q, own in asked.groupby("src"):
            w = np.unique(_joined(own["a"], np.int64))
            d = ((decode(vec[np.searchsorted(node, w)]) - decode(_bytes([own["b"].iloc[0]]))) ** 2).sum(1)
            at = np.argsort(d, kind="stable")[:beam]
            out.append((q, key[0], w[at].tobytes(), d[at].astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["q", "home", "a", "d"]).astype({"q": "int64", "home": "int32"})

    def merge(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        w, whome, d, done = (np.frombuffer(row[c], t) for c, t in (("w", np.int64), ("whome", np.int32), ("d", np.float32), ("done", np.uint8)))
        homes = np.repeat(found["home"].to_numpy(), [len(x) // 8 for x in found["a"]])
        w, whome, d = np.concatenate([w, _joined(found["a"], np.int64)]), np.concatenate([whome, homes]).astype(np.int32), np.concatenate([d, _joined(found["d"], np.float32)])
        done = np.concatenate([done, np.zeros(len(w) - len(done), np.uint8)])
        at = _nearest(np.zeros(len(w), np.int64), w, d, 1 - done, beam)  # the one that is done comes first
        out = {"q": key[0], "home": row["home"], "qvec": row["qvec"], "w": w[at].tobytes(), "whome": whome[at].tobytes(), "d": d[at].tobytes(), "done": done[at].tobytes()}
        return pd.DataFrame([out]).astype({"home": "int32"})

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, qvec, w, whome, done in zip(pdf["q"], pdf["qvec"], pdf["w"], pdf["whome"], pdf["done"], strict=True):
                todo = np.flatnonzero(np.frombuffer(done, np.uint8) == 0)[:step]
                ids = np.frombuffer(w, np.int64)[todo]
                out += [(h, q, ids[k].tobytes(), qvec) for h, k in _by_home(np.frombuffer(whome, np.int32)[todo])]
            yield pd.DataFrame(out, columns=["home", "src", "a", "b"]).astype({"home": "int32", "src": "int64"})

    def expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            marks = []
            for raw in pdf["done"]:
                done = np.frombuffer(raw, np.uint8).copy()
                done[np.flatnonzero(done == 0)[:step]] = 1
                marks.append(done.tobytes())
            pdf["done"] = marks
            yield pdf

    note = "home int, src long, a binary, b binary"
    zero = [F.lit(np.zeros(1, t).tobytes()) for t in (np.float32, np.uint8)]

    def raw_number(c: str, width: int) -> Column:
        """A whole number as bytes in the order that numpy reads."""
        return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * width, "0"), 2 * k + 1, 2) for k in reversed(range(width))]))

    held = written(queries.select(F.col("node").alias("q"), "home", F.col("vec").alias("qvec"), raw_number("node", 8).alias("w"), raw_number("home", 4).alias("whome"), zero[0].alias("d"), zero[1].alias("done")))
    while held.where(F.locate("00", F.regexp_replace(F.hex("done"), "(..)", "$1 ")) > 0).limit(1).count():
        asked = held.mapInPandas(asks, note)
        led = near.groupBy("home").cogroup(asked.groupBy("home")).applyInPandas(look_up, note)
        found = vectors.groupBy("home").cogroup(led.groupBy("home")).applyInPandas(measure, "q long, home int, a binary, d binary")
        old, held = held, written(held.mapInPandas(expanded, names).groupBy("q").cogroup(found.groupBy("q")).applyInPandas(merge, names))
        discard(old)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            if w:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in w])), pa.array(np.concatenate(w))], ["q", "w"])

    return held.select("q", "w").mapInArrow(listed, "q long, w long")


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) of vectors that take part: of the most frequent length, not zero, without null or non-finite parts."""
    v = F.col(vector)
    kind = df.schema[vector].dataType.elementType.simpleString()
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)).alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def nearest_neighbours(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, degree: int = 32, sample: int = 16, rounds: int = 10, beam: int = 192, step: int = 96) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean, in double precision) of the k nearest rows found for each query.

    is_query is a condition on the column vec_id. Rows with a null id and vectors that are null, zero, of another length
    than most or hold null or non-finite parts take no part; rows that repeat an id with the same vector count once. Equal
    vectors are one node of the graph, and each brings its k + 1 smallest ids, which is all that can rank. Ties go to
    the smaller id; a query with fewer candidates returns them all. The graph is built and walked on half-precision
    copies, in which vectors below 1e-38 of the largest number count as zero; what is found is measured on the vectors
    themselves. Empty tables give an empty result; other columns are
    left out.
    """
    rows = checkpoint(clean_vectors(df, key, vector).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")))
    spark = df.sparkSession
    kinds = checkpoint(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.min_by("vec", "vec_id").alias("vec"), F.count("*").alias("n")))
    head = kinds.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    count, top = head["n"], head["top"]
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) / top
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in encode(values)], pa.binary())], ["node", "vec"])

    state = build_graph(arrow_map(kinds.select("node", "vec"), pack, "node long, vec binary"), count, degree, sample, rounds)
    asked = checkpoint(rows.where(is_query).select("vec_id", "h1", "h2").distinct().join(kinds.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "node"))
    pairs = walk(state.join(asked.select("node").distinct(), "node", "left_semi"), state, degree, max(beam, k + 1), step)
    exact = kinds.select("node", F.transform("vec", lambda x: x.cast("double")).alias("v"))
    scored = pairs.join(exact.select(F.col("node").alias("q"), F.col("v").alias("a")), "q").join(exact.select(F.col("node").alias("w"), F.col("v").alias("b")), "w")
    score = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "w"))
    scored = scored.select("q", "w", score.alias("score")).withColumn("place", place).where(F.col("place") <= k + 1).drop("place")  # each node stands for a row at least; a node comes with its smallest id
    twins = kinds.where("n > 1").select("h1", "h2", "node").join(rows.select("h1", "h2", "vec_id").distinct(), ["h1", "h2"])
    first = Window.partitionBy("node").orderBy("vec_id")
    others = twins.select("node", "vec_id").withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).select(F.col("node").alias("w"), "vec_id")
    members = kinds.where("n = 1").select(F.col("node").alias("w"), F.col("node").alias("vec_id")).unionByName(others)
    answers = scored.join(members, "w").select(F.col("q").alias("node"), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    out = asked.join(answers, "node").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
