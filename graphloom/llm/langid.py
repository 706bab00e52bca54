"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Every byte position of a whole text gets probabilities from the states that a forward and a backward GRU have there; a
document's probability is the mean over its positions (repeats included). Texts are read in stretches of 128 bytes that
all run side by side; in each, the states start at zero.

Training: backpropagation through time with Adam, on at most ``per_language`` documents of each language and
``per_document`` stretches from anywhere in each; which ones is decided by hashes, so it is the same on every run and
does not depend on partitions. This bound is on the fit alone: prediction reads every byte of every text.

Nulls, empty texts and texts without a letter are ``und`` with score 0. Documents without a language are not learned
from. Without any labelled document everything is ``und``. Only the text is an input of a prediction. Ties of probability
go to the language that comes first by code point; repeated rows get equal answers; an empty table gives no rows. ``predict``
passes columns of any name but lang_pred and score, which it makes anew."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import column, mapped, slices_by_bytes, staged

HIDDEN, STRETCH = 8, 128
PER_LANGUAGE, PER_DOCUMENT = 400, 3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """A GRU of one direction. Gates stand side by side: update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # a byte's share of the gates, bias included
        self.gates = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.own = rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)

    def forward(self, bytes_: np.ndarray):
        """bytes_: steps x batch. States after each step, and what the way back needs."""
        h, n = self.h, bytes_.shape[1]
        state, states, kept = np.zeros((n, h), np.float32), [], []
        for row in bytes_:
            x = self.table[row]
            g = sigmoid(x[:, : 2 * h] + state @ self.gates)
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ self.own)
            kept.append((row, state, z, r, c))
            state = state + z * (c - state)
            states.append(state)
        return np.stack(states), kept

    def backward(self, kept, d_states: np.ndarray):
        h = self.h
        d_table, d_gates, d_own = (np.zeros_like(x) for x in (self.table, self.gates, self.own))
        carry = np.zeros_like(d_states[0])
        for t in range(len(kept) - 1, -1, -1):
            row, state, z, r, c = kept[t]
            d = d_states[t] + carry
            dc = d * z * (1 - c * c)
            rs = r * state
            d_rs = dc @ self.own.T
            d_own += rs.T @ dc
            dg = np.concatenate([d * (c - state) * z * (1 - z), d_rs * state * r * (1 - r)], axis=1)
            d_gates += state.T @ dg
            np.add.at(d_table, row, np.concatenate([dg, dc], axis=1))
            carry = d * (1 - z) + d_rs * r + dg @ self.gates.T
        return d_table, d_gates, d_own


class ByteGru:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.ways = (Direction(rng, hidden), Direction(rng, hidden))
        self.out = rng.normal(0, 0.1, (2 * hidden, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [x for w in self.ways for x in (w.table, w.gates, w.own)] + [self.out, self.bias]

    def gradients(self, bytes_: np.ndarray, valid: np.ndarray, truth: np.ndarray):
        """bytes_, valid: steps x batch; truth: label of each column."""
        forth, kept_forth = self.ways[0].forward(bytes_)
        back, kept_back = self.ways[1].forward(bytes_[::-1])
        both = np.concatenate([forth, back[::-1]], axis=2)
        scores = both @ self.out + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        pick = np.take_along_axis(p, np.broadcast_to(truth[None, :, None], (*p.shape[:2], 1)), 2)[..., 0]
        n = max(int(valid.sum()), 1)
        loss = float(-(np.log(pick + 1e-9) * valid).sum() / n)
        d = p
        np.put_along_axis(d, np.broadcast_to(truth[None, :, None], (*d.shape[:2], 1)), (pick - 1)[..., None], 2)
        d *= (valid / n)[..., None].astype(np.float32)
        d_out, d_bias = np.einsum("tbi,tbj->ij", both, d, optimize=True), d.sum(axis=(0, 1))
        d_both = d @ self.out.T
        h = self.hidden
        return loss, [*self.ways[0].backward(kept_forth, d_both[..., :h]), *self.ways[1].backward(kept_back, d_both[::-1, :, h:]), d_out, d_bias]

    def fit(self, stretches: np.ndarray, lengths: np.ndarray, truth: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 2) -> ByteGru:
        rng, weights = np.random.default_rng(seed), self.weights()
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        rounds = epochs * -(-len(truth) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(truth))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                valid = np.arange(stretches.shape[1])[:, None] < lengths[own][None, :]
                _, grads = self.gradients(stretches[own].T, valid, truth[own])
                norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
                step += 1
                now = rate * (1 - 0.9 * step / rounds)
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def position_probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """bytes_: stretches x steps. Probabilities of each position: stretches x steps x labels."""
        n, steps = bytes_.shape
        h = self.hidden
        both = np.empty((steps, n, 2 * h), np.float32)
        for way, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            d = self.ways[way]
            state = np.zeros((n, h), np.float32)
            table = d.table * np.float32(0.5)
            table[:, 2 * h :] *= 2
            gates = d.gates * np.float32(0.5)
            rows, x, g, c = np.ascontiguousarray(bytes_.T), np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
            for t in order:
                np.take(table, rows[t], axis=0, out=x, mode="clip")
                np.matmul(state, gates, out=g)
                g += x[:, : 2 * h]
                np.tanh(g, out=g)  # sigmoid(v) = (tanh(v / 2) + 1) / 2
                g += 1
                g *= np.float32(0.5)
                np.multiply(g[:, h:], state, out=c)
                c = c @ d.own
                c += x[:, 2 * h :]
                np.tanh(c, out=c)
                c -= state
                c *= g[:, :h]
                state += c
                both[t, :, way * h : way * h + h] = state
        scores = both.reshape(-1, 2 * h) @ self.out
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores.reshape(steps, n, -1).transpose(1, 0, 2)

    def document_probabilities(self, texts: list[bytes], together: int = 2048) -> np.ndarray:
        """Mean of the probabilities of all positions of each text; zeros for an empty one."""
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // STRETCH)
        sums = np.zeros((len(texts), len(self.labels)))
        owner = np.repeat(np.arange(len(texts)), pieces)
        flat = np.zeros(int(pieces.sum()) * STRETCH, np.uint8)
        starts = (np.cumsum(pieces) - pieces) * STRETCH
        for s, t in zip(starts.tolist(), texts, strict=True):
            flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
        grid = flat.reshape(-1, STRETCH)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        filled = np.minimum(STRETCH, lengths[owner] - within * STRETCH)
        order = np.argsort(-filled, kind="stable")
        for at in range(0, len(order), together):
            own = order[at : at + together]
            steps = int(filled[own[0]])
            p = self.position_probabilities(grid[own, :steps])
            if filled[own[-1]] < steps:
                p = p * (np.arange(steps)[None, :, None] < filled[own][:, None, None])
            np.add.at(sums, owner[own], p.sum(axis=1, dtype=np.float64))
        return sums / np.maximum(lengths, 1)[:, None]


def stretches_of(text: str, doc_id, few: int) -> list[bytes]:
    """Up to so many stretches from anywhere in a text, chosen by hash."""
    data = text.encode("utf-8", "surrogatepass")
    n = -(-len(data) // STRETCH)
    places = range(n) if n <= few else sorted({zlib.crc32(f"{doc_id}/{k}".encode()) % n for k in range(few)})
    return [data[p * STRETCH : (p + 1) * STRETCH] for p in places]


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT):
    """Stretches of a bounded sample of labelled documents (text, lang, doc_id): about per_language of each language."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("doc_id", "lang", "text")
    # a document is in the sample if its hash is below its language's share of the range
    shares = labelled.groupBy(F.col("lang").alias("l")).agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(staged(shares, "language-shares"), F.col("lang") == F.col("l")).filter(place < F.col("share")).select("doc_id", "lang", "text")

    def cut(batches):
        for batch in batches:
            rows = [(lang, d, s) for d, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for s in stretches_of(text, d, per_document)]
            if rows:
                langs, _, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], names=["lang", "data"])

    rows = sorted((r.lang, bytes(r.data)) for r in sample.transform(mapped, cut, "lang string, data binary").collect())  # bounded by the two parameters
    labels = sorted({lang for lang, _ in rows})
    grid = np.zeros((len(rows), STRETCH), np.uint8)
    for k, (_, data) in enumerate(rows):
        grid[k, : len(data)] = np.frombuffer(data, np.uint8)
    number = {lang: k for k, lang in enumerate(labels)}
    return labels, grid, np.array([len(d) for _, d in rows], np.int64), np.array([number[lang] for lang, _ in rows], np.int64)


def train(docs: DataFrame, **bounds: int) -> ByteGru | None:
    labels, grid, lengths, truth = training_rows(docs, **bounds)
    return ByteGru(labels).fit(grid, lengths, truth) if labels else None


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def judged(model: ByteGru | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each text."""
    lettered = np.array([has_letter(t) for t in texts], bool)
    label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if model is not None and lettered.any():
        p = model.document_probabilities([t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, lettered, strict=True) if ok])
        best = p.argmax(axis=1)
        label[lettered] = np.array(model.labels, object)[best]
        score[lettered] = np.clip(p[np.arange(len(best)), best], 0, 1)
    return label, score


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """The columns of docs but text, with lang_pred and score."""
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            label, score = judged(model, column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(label, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*names, "text").transform(mapped, run, f"{fields}lang_pred string, score double")


def held_out():
    """True for documents that are never learned from: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that aren't held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs whose language is known: those that are und, or in no language with this score, go."""
    model = train(docs.filter(~held_out()))

    def keep(batches):
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            label, score = judged(model, column(batch, "text").to_pylist())
            yield batch.filter(pa.array((label != "und") & (score >= least), pa.bool_()))

    return docs.transform(mapped, keep, docs.schema)
