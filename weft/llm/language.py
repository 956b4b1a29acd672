"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads whole texts as UTF-8 bytes in lower case, forwards and backwards, and
labels every byte, spaces, digits and punctuation too; a document's probabilities are the
mean over all its bytes. It is trained in numpy by backpropagation through time on a
bounded sample of labelled rows.

A text is labelled in chunks of CHUNK bytes, read in step as lanes. Before its chunk a lane
reads the CONTEXT bytes next to it in its direction, so the state carries over the chunks'
edges. Chunks begin at multiples of CHUNK of the text: a label depends on the text alone, up
to rounding in the last places, as products are formed over lanes of several texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import extended, in_arrow, named, table
from weft.llm.hashing import spread

#: Bound of the training sample: labelled documents, and stretches of each, drawn from the whole text.
SAMPLE_DOCS, SAMPLE_STRETCHES = 3000, 16
#: Units in each direction, training steps, stretches in a step and bytes of a stretch.
HIDDEN, STEPS, STEP_STRETCHES, STRETCH = 12, 500, 64, 48
#: Bytes that a lane labels, bytes that it reads before, and lanes in step.
CHUNK, CONTEXT, LANES = 224, 32, 1024
#: Text bytes labelled together.
BATCH = 2 << 20
#: The byte beyond a text's ends: it leaves the state as it is.
_BEYOND = 256
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _MAYBE.finditer(text or ""))


def _sigmoid(x):
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    """One gated recurrent layer in each direction and a linear label at each position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        small = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"out": small(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":  # by direction: what a byte adds to the gates, and the state's part
            self.p[d + "in"], self.p[d + "rec"] = small(256, 3 * hidden), small(hidden, 3 * hidden)

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the columns of x (runs, steps)."""
        h, w, u = self.h, self.p[d + "in"], self.p[d + "rec"]
        s, out = np.zeros((len(x), h), np.float32), np.empty((x.shape[1], len(x), h), np.float32)
        for t in range(x.shape[1]):
            a, b = w[x[:, t]], s @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            if keep is not None:
                keep.append((s, z, r, n, b[:, 2 * h :]))
            s = n + z * (s - n)
            out[t] = s
        return out

    def _back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
        """Through time: gradients of the byte and state weights from those of the states."""
        h, u = self.h, self.p[d + "rec"]
        wrec, carry, gates = np.zeros_like(u), np.zeros((len(x), h), u.dtype), np.empty((x.shape[1], len(x), 3 * h), u.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            s, z, r, n, b = kept[t]
            g = grad[t] + carry
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (s - n) * z * (1 - z)
            dr = dn * b * r * (1 - r)
            gates[t] = np.concatenate((dz, dr, dn), 1)
            rec = np.concatenate((dz, dr, dn * r), 1)
            wrec += s.T @ rec
            carry = g * z + rec @ u.T
        column = x.T.ravel()
        order = np.argsort(column, kind="stable")
        seen, begin = np.unique(column[order], return_index=True)
        win = np.zeros_like(self.p[d + "in"])
        win[seen] = np.add.reduceat(gates.reshape(-1, 3 * h)[order], begin, 0)
        into[d + "in"], into[d + "rec"] = win, wrec

    def _states(self, d: str, x: np.ndarray, first: int) -> np.ndarray:
        """States after each of the columns of x from `first` on, as _run has them, without new arrays a step.

        Gates are kept apart, so that every operation goes over one stretch of memory.
        """
        h, lanes = self.h, len(x)
        w = np.concatenate((self.p[d + "in"], np.zeros((1, 3 * h), np.float32)))
        w[_BEYOND, :h] = 80
        w, u = (np.ascontiguousarray(k.reshape(-1, 3, h).transpose(1, 0, 2)) for k in (w, self.p[d + "rec"]))
        w[:2] *= -1
        u[:2] *= -1
        s, out = np.zeros((lanes, h), np.float32), np.empty((x.shape[1] - first, lanes, h), np.float32)
        a, b = np.empty((3, lanes, h), np.float32), np.empty((3, lanes, h), np.float32)
        (z, r, n), gates, gates_b, n_b = a, a[:2], b[:2], b[2]
        for t, column in enumerate(np.ascontiguousarray(x.T)):
            for k in range(3):
                np.take(w[k], column, 0, a[k], "clip")
                np.matmul(s, u[k], b[k])
            gates += gates_b
            np.exp(gates, gates)
            gates += 1
            np.reciprocal(gates, gates)
            n_b *= r
            n += n_b
            np.tanh(n, n)
            s -= n
            s *= z
            s += n
            if t >= first:
                out[t - first] = s
        return out

    def pooled(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums (lanes, labels) of the probabilities of the `size` bytes of each lane of x, which stand between CONTEXT columns."""
        forward = self._states("f", x[:, : x.shape[1] - CONTEXT], CONTEXT)
        back = self._states("b", x[:, : CONTEXT - 1 : -1], CONTEXT)[::-1]
        of, ob = np.ascontiguousarray(self.p["out"][: self.h].T), np.ascontiguousarray(self.p["out"][self.h :].T)
        e = of @ forward.transpose(0, 2, 1)
        e += ob @ back.transpose(0, 2, 1)
        e += self.p["bias"][:, None]
        e -= e.max(1, keepdims=True)
        np.exp(e, e)
        e /= e.sum(1, keepdims=True)
        e *= (np.arange(len(e))[:, None] < size)[:, None, :]
        return e.sum(0, dtype=np.float64).T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions and its gradients."""
        kf, kb = [], []
        states = np.concatenate((self._run("f", x, kf), self._run("b", x[:, ::-1], kb)[::-1]), 2)
        e = states @ self.p["out"] + self.p["bias"]
        e = np.exp(e - e.max(2, keepdims=True))
        prob = e / e.sum(2, keepdims=True)
        own = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*prob.shape[:2], 1)), 2)
        loss = float(-np.log(own + 1e-12).mean())
        d = prob.copy()
        d[:, np.arange(len(y)), y] -= 1
        d /= d.shape[0] * d.shape[1]
        flat = states.reshape(-1, 2 * self.h)
        g = {"out": flat.T @ d.reshape(-1, d.shape[2]), "bias": d.sum((0, 1))}
        ds = d @ self.p["out"].T
        self._back("f", x, kf, ds[:, :, : self.h], g)
        self._back("b", x[:, ::-1], kb, ds[::-1, :, self.h :], g)
        return loss, g

    def train(self, stretches: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam; a step draws stretches of one length, each language as often."""
        r = np.random.default_rng(seed)
        size = np.array([len(b) for b in stretches])
        by: dict[int, tuple] = {}
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = np.frombuffer(b"".join(stretches[i] for i in at), np.uint8).reshape(-1, d)
            n = np.bincount(y[at], minlength=len(self.labels))
            by[int(d)] = (x, y[at], (1.0 / n[y[at]]) / (n > 0).sum(), len(at) * d)
        lengths = list(by)
        share = np.array([by[d][3] for d in lengths], float)
        m, v = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            x, own, weight, _ = by[lengths[r.choice(len(lengths), p=share / share.sum())]]
            at = r.choice(len(own), STEP_STRETCHES, p=weight)
            _, g = self.gradients(x[at], own[at])
            rate = 0.02 * min(1.0, 2.0 * (1 - (step - 1) / steps))
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Labeller:
    """Pools the labels of all bytes of texts."""

    def __init__(self, network: Network):
        self.network = network

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities (texts, labels) over all bytes of each text; an empty one has none."""
        bufs = [_bytes(t) for t in texts]
        size = np.array([len(b) for b in bufs], np.int64)
        end = np.cumsum(size)
        arr = np.frombuffer(b"".join(bufs), np.uint8).astype(np.int16)
        n = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(texts)), n)
        start = np.repeat(end - size, n) + CHUNK * spread(np.zeros(len(n), np.int64), n)
        own = np.minimum(CHUNK, end[doc] - start)
        total = np.zeros((len(texts), len(self.network.labels)))
        order = np.argsort(-own, kind="stable")
        for at in range(0, len(order), LANES):
            lane = order[at : at + LANES]
            of = doc[lane]
            where = start[lane][:, None] + np.arange(-CONTEXT, own[lane[0]] + CONTEXT)
            inside = (where >= (end - size)[of][:, None]) & (where < end[of][:, None])
            x = np.where(inside, arr[np.clip(where, 0, len(arr) - 1)], _BEYOND)
            np.add.at(total, of, self.network.pooled(x, own[lane]))
        return total / np.maximum(size, 1)[:, None]

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        prob = self.probabilities(texts)
        best = prob.argmax(1)
        return [self.network.labels[i] for i in best], np.clip(prob[np.arange(len(texts)), best], 0, 1).tolist()


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _sample(stretches: int):
    """Stretches of STRETCH bytes from anywhere in the text, or the whole of a shorter one; of no letter none."""

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                buf = _bytes(text) if has_letter(text) else b""
                last = max(len(buf) - STRETCH, 0)
                n = min(stretches, -(-len(buf) // STRETCH))
                at = np.random.default_rng(key & 0xFFFFFFFF).integers(0, last + 1, n)
                out.append([buf[i : i + STRETCH] for i in at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.binary()))], names=["key", "lang", "stretches"])

    return run


def _remainder(id_col: str):
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")), F.lit(0)) % 5


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, stretches: int = SAMPLE_STRETCHES) -> Network | None:
    """A network trained on at most `docs` labelled rows, chosen by a hash of their id, and `stretches` stretches of each text; None if no row is labelled."""
    rows = df.where(named(lang_col).isNotNull() & named(text_col).isNotNull()).select(
        F.xxhash64(F.lit("language"), named(id_col)).alias("key"), named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")
    )
    labelled = rows.select("key").count()
    if not labelled:
        return None
    share = min(1_000_000, int(1_300_000 * docs / labelled) + 1)
    some = rows.where(F.pmod("key", F.lit(1_000_000)) < share)
    got = in_arrow(some, _sample(stretches), "key bigint, lang string, stretches array<binary>").orderBy("key", "lang").limit(docs).collect()
    labels = sorted({r.lang for r in got if r.stretches})
    if not labels:
        return None
    pairs = [(bytes(b), labels.index(r.lang)) for r in got for b in r.stretches]
    network = Network(labels)
    network.train([b for b, _ in pairs], np.array([y for _, y in pairs]))
    return network


def _predict(sent):
    """The first column is the text, and goes."""

    def run(batches):
        network = sent.value
        labeller = Labeller(network) if network else None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= BATCH):
                    size += len(texts[to] or "")
                    to += 1
                own = texts[at:to]
                ok = [labeller is not None and has_letter(t) for t in own]
                lang, score = labeller([t for t, k in zip(own, ok, strict=True) if k]) if any(ok) else ([], [])
                lang, score = iter(lang), iter(score)
                part = batch.slice(at, to - at)
                new = [pa.array([next(lang) if k else "und" for k in ok], pa.string()), pa.array([next(score) if k else 0.0 for k in ok], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[*batch.schema.names[1:], "lang_pred", "score"])
                at = to

    return run


def _identified(df: DataFrame, network: Network | None, text_col: str, keep: list[str]) -> DataFrame:
    """c0, c1, ... (the columns `keep`), lang_pred, score."""
    rows = df.select(named(text_col).alias("text"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = extended(rows.schema.fields[1:], "lang_pred string, score double")
    return in_arrow(rows, _predict(df.sparkSession.sparkContext.broadcast(network)), schema)


def identify(df: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (default: all) with lang_pred and score, which replace columns of these names.

    `und` with score 0 where the text is null or has no letter (or nothing was learned).
    Whole texts are read. An empty table gives no rows.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    found = _identified(df, network, text_col, keep)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = fit(docs.where(_remainder("doc_id") != 0))
    found = identify(docs, network, keep=["doc_id"])
    return found.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def _lettered(at: int):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def reject_unknown(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (null, empty or letterless texts) go.

    So too where no row to learn from is labelled: every text with a letter stays. An
    empty table gives no rows; all columns, whatever their names, keep their values.
    """
    network = fit(docs.where(_remainder("doc_id") != 0))
    if network is None:
        return in_arrow(docs, _lettered(docs.columns.index("text")), docs.schema)
    found = _identified(docs, network, "text", docs.columns).where("lang_pred <> 'und'")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
