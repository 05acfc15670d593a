"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a word vector (hashed) and the mean of the vectors of its character runs
(hashed, with word borders), with the log-odds of the word and of its most telling run, so unseen
forms of known stems are recognised. Texts are cut into
overlapping windows of words, every window is scored, and a text has its highest window's score.

Training uses a bounded, hash-ordered sample of the labelled rows outside the held-out fold. A
text's label says only that some window is toxic, so each round learns from the window of each text
that the network finds most toxic, and from another window of clean texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, held_out

#: At most so many texts of either label are learned from, each as a whole.
SAMPLE_TEXTS = 1500
WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH, WORD_BUCKETS, CHAR_BUCKETS = 8, 8, 2**14, 2**16
GRAMS = (3, 4, 5)
#: A word's inputs: WIDTH learned numbers, the log-odds of the word, the highest of its character runs.
INPUTS = WIDTH + 2

SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("n_windows", T.IntegerType())])


def word_buckets(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words: (buckets, where each word's start) for the words themselves, then for their
    character runs of each length, borders included."""
    if not words:
        return [(np.empty(0, np.int64), np.empty(0, np.int64))] * (1 + len(GRAMS))
    own = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, len(words))
    out = [(own, np.arange(len(words)))]
    edged = [(b"<" + w + b">").ljust(max(GRAMS), b"~") for w in words]
    text = np.frombuffer(b"".join(edged), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, edged), np.int64, len(edged))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))  # characters up to the word's end
    for n in GRAMS:
        h = np.zeros(len(text) - n + 1, np.uint32)
        for i in range(n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + text[i : len(text) - n + 1 + i]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x297A2D39)
        runs = ((h >> np.uint32(8))[left[: len(h)] >= n] % np.uint32(CHAR_BUCKETS)).astype(np.int32) + np.int32(WORD_BUCKETS)
        counts = lengths - (n - 1)
        out.append((runs, np.cumsum(counts) - counts))
    return out


def text_words(text: str | None) -> list[bytes]:
    """Words in lower case, bare of the punctuation around them."""
    return [w.strip(b".,;:!?\"'()[]{}*#$%&|<>-_") for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start_parameters(odds: np.ndarray, seed: int = 6) -> dict[str, np.ndarray]:
    """Parameters as float32 arrays: vectors E and log-odds L of the buckets, per direction the input
    weights W (input, 3 hidden), bias B and recurrent weights U (hidden, 3 hidden), attention A, V
    and the output O, c."""
    rng = np.random.default_rng(seed)

    def draw(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    h = HIDDEN
    p = {"E": draw(WORD_BUCKETS + CHAR_BUCKETS, WIDTH, scale=0.1)}
    for d in "fb":
        p |= {f"W{d}": draw(INPUTS, 3 * h, scale=INPUTS**-0.5), f"B{d}": np.zeros(3 * h, np.float32), f"U{d}": draw(h, 3 * h, scale=h**-0.5)}
    return p | {"A": draw(2 * h, h, scale=0.3), "V": draw(h, scale=0.3), "O": draw(2 * h, scale=0.3), "c": np.full(1, -1.0, np.float32), "L": odds.astype(np.float32)}


def flattened(parts: list[tuple[np.ndarray, np.ndarray]]):
    """All buckets of words in one array, whose they are, and their weight in the word's vector."""
    n = len(parts[0][0])
    owners = [np.repeat(np.arange(n), np.diff(np.append(starts, len(b)))) for b, starts in parts]
    runs = np.bincount(np.concatenate(owners[1:]), minlength=n)
    weights = [np.ones(n, np.float32), *((1 / runs).astype(np.float32)[o] for o in owners[1:])]
    return np.concatenate([b for b, _ in parts]), np.concatenate(owners), np.concatenate(weights)


def bucket_odds(docs: list[np.ndarray], y: np.ndarray, parts, prior: float = 8.0) -> np.ndarray:
    """Log-odds of the label for each bucket by the texts it is in, drawn to 0 where these are few."""
    counts = np.zeros((2, WORD_BUCKETS + CHAR_BUCKETS))
    spans = [(buckets, starts, np.append(starts[1:], len(buckets))) for buckets, starts in parts]
    for words, label in zip(docs, y, strict=True):
        used = np.unique(words)
        own = []
        for buckets, starts, ends in spans:
            begin, size = starts[used], ends[used] - starts[used]
            own.append(buckets[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
        counts[label, np.unique(np.concatenate(own))] += 1
    n = np.bincount(y, minlength=2)
    share = n / n.sum()
    odds = np.log((counts[1] + prior * share[1]) / (counts[0] + prior * share[0]) * n[0] / max(n[1], 1))
    return np.clip(odds / 2, -2, 2)


def vectors(p: dict, parts) -> np.ndarray:
    """Inputs of words: word vector plus the mean of its runs', and the log-odds."""
    own = parts[0][0]
    n = len(own)
    total, count, high = np.zeros((n, WIDTH), np.float32), np.zeros(n, np.float32), np.full(n, -9, np.float32)
    for runs, starts in parts[1:]:
        total += np.add.reduceat(p["E"].take(runs, axis=0), starts, axis=0)
        count += np.diff(np.append(starts, len(runs)))
        np.maximum(high, np.maximum.reduceat(p["L"].take(runs), starts), out=high)
    return np.concatenate([p["E"].take(own, axis=0) + total / count[:, None], p["L"].take(own)[:, None], high[:, None]], axis=1)


def run_direction(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
    """Gated recurrence over (step, window, 3 hidden) input projections; all hidden states, and what
    the backward pass needs if ``keep``."""
    steps, n, h3 = gates.shape
    h = h3 // 3
    state = np.zeros((n, h), np.float32)
    out = np.empty((steps, n, h), np.float32)
    kept = []
    ur, uc = u[:, : 2 * h], u[:, 2 * h :]
    for t in range(steps):
        rz = gates[t, :, : 2 * h] + state @ ur
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:, :h], rz[:, h:]
        c = (r * state) @ uc
        c += gates[t, :, 2 * h :]
        np.tanh(c, out=c)
        new = c - state
        new *= z
        new *= mask[t][:, None]
        new += state
        if keep:
            kept.append((state, r, z, c))
        state = out[t] = new
    return out, kept


def forward(p: dict, index: np.ndarray, projected: dict, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``index`` (step, window) points into ``projected`` (per direction, the
    input projections of the distinct words); ``mask`` is 1 where a word is."""
    n = index.shape[1]
    f, kf = run_direction(projected["f"][index], p["Uf"], mask, keep)
    b, kb = run_direction(projected["b"][index[::-1]], p["Ub"], mask[::-1], keep)
    both = np.concatenate([f, b[::-1]], axis=2)
    inner = np.tanh(both.reshape(-1, 2 * HIDDEN) @ p["A"])
    e = (inner @ p["V"]).reshape(-1, n) + (mask - 1) * 30
    e -= e.max(axis=0)
    w = np.exp(e)
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, both)
    logit = pooled @ p["O"] + p["c"][0]
    return logit, (both, inner, w, pooled, kf, kb)


def logits(p: dict, index: np.ndarray, projected: dict, mask: np.ndarray) -> np.ndarray:
    """What ``forward`` gives, laid out for speed: windows along the last axis, gates by tanh of half
    the input, the halves moved into the weights."""
    steps, n = index.shape
    h = HIDDEN
    full = mask.all(axis=1)
    both = np.empty((steps, 2 * h, n), np.float32)
    for d, at in (("f", 0), ("b", h)):
        ur = np.ascontiguousarray(p[f"U{d}"][:, : 2 * h].T) * np.float32(0.5)
        uc = np.ascontiguousarray(p[f"U{d}"][:, 2 * h :].T) * np.float32(0.5)
        table = projected[d]
        state = np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = table.take(index[t], axis=0).T
            rz = ur @ state
            rz += g[: 2 * h]
            np.tanh(rz, out=rz)
            r, z = rz[:h], rz[h:]
            r *= state
            r += state
            c = uc @ r
            c += g[2 * h :]
            np.tanh(c, out=c)
            c -= state
            z *= c
            z += c
            z *= np.float32(0.5)
            if not full[t]:
                z *= mask[t]
            state = np.add(state, z, out=both[t, at : at + h])
    inner = np.matmul(p["A"].T, both)
    np.tanh(inner, out=inner)
    e = np.matmul(p["V"], inner) + (mask - 1) * 30
    e -= e.max(axis=0)
    np.exp(e, out=e)
    value = np.matmul(p["O"], both)
    return (e * value).sum(axis=0) / e.sum(axis=0) + p["c"][0]


def backward(p: dict, d_logit: np.ndarray, index: np.ndarray, mask: np.ndarray, saved) -> tuple[dict, dict]:
    """Gradients of the parameters (but E and the input weights), and of the input projections."""
    both, inner, w, pooled, kf, kb = saved
    steps, n = index.shape
    h = HIDDEN
    g = {"O": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["O"]
    d_w = np.einsum("nh,tnh->tn", d_pooled, both)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    d_both = w[:, :, None] * d_pooled
    flat = d_e.reshape(-1, 1)
    g["V"] = (inner * flat).sum(axis=0)
    d_inner = flat * p["V"] * (1 - inner**2)
    g["A"] = both.reshape(-1, 2 * h).T @ d_inner
    d_both = d_both + (d_inner @ p["A"].T).reshape(both.shape)
    d_gates = {}
    for d, kept, part, m in (("f", kf, d_both[:, :, :h], mask), ("b", kb, d_both[::-1, :, h:], mask[::-1])):
        u = p[f"U{d}"]
        d_u = np.zeros_like(u)
        d_g = np.zeros((steps, n, 3 * h), np.float32)
        d_state = np.zeros((n, h), np.float32)
        for t in reversed(range(steps)):
            state, r, z, c = kept[t]
            d_new = (d_state + part[t]) * m[t][:, None]
            rest = (d_state + part[t]) * (1 - m[t])[:, None]
            d_c = d_new * z * (1 - c**2)
            d_z = d_new * (c - state) * z * (1 - z)
            d_rs = d_c @ u[:, 2 * h :].T
            d_r = d_rs * state * r * (1 - r)
            d_rz = np.concatenate([d_r, d_z], axis=1)
            d_g[t] = np.concatenate([d_rz, d_c], axis=1)
            d_u[:, : 2 * h] += state.T @ d_rz
            d_u[:, 2 * h :] += (r * state).T @ d_c
            d_state = rest + d_new * (1 - z) + d_rs * r + d_rz @ u[:, : 2 * h].T
        g[f"U{d}"] = d_u
        g[f"B{d}"] = d_g.sum(axis=(0, 1))
        d_gates[d] = d_g if d == "f" else d_g[::-1]
    return g, d_gates


def cut(n: int) -> list[tuple[int, int]]:
    """Windows (start, end) over n words: every STRIDE words, the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def pack(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) indexes and mask; index 0 fills up."""
    index = np.zeros((WINDOW, len(windows)), np.int64)
    mask = np.zeros((WINDOW, len(windows)), np.float32)
    for i, w in enumerate(windows):
        index[: len(w), i] = w
        mask[: len(w), i] = 1
    return index, mask


def project(p: dict, words: list[bytes], halved: bool = False) -> dict:
    """Input projections of words, for ``logits`` with the gates' part halved."""
    out = {d: np.empty((len(words), 3 * HIDDEN), np.float32) for d in "fb"}
    for i in range(0, len(words), 8192):
        x = vectors(p, word_buckets(words[i : i + 8192]))
        for d in "fb":
            part = x @ p[f"W{d}"] + p[f"B{d}"]
            if halved:
                part[:, : 2 * HIDDEN] *= 0.5
            out[d][i : i + 8192] = part
    return out


def window_logits(p: dict, windows: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    proj = project(p, words, halved=True)
    return np.concatenate([logits(p, index, proj, mask) for index, mask in (pack(windows[i : i + 1024]) for i in range(0, len(windows), 1024))])


def train(texts: list[str], labels: list[int], rounds: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 6, odds: bool = True) -> dict:
    """Parameters learned from texts with labels 0 and 1, by Adam; the same for the same input.

    One text in five only serves to set the level at which a text counts as toxic: the one that
    gives the best balance (F1) of found and falsely found texts."""
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {b"": 0}
    docs, y = [], []
    for t, label in zip(texts, labels, strict=True):
        numbers = np.array([vocab.setdefault(w, len(vocab)) for w in text_words(t)], np.int32)
        if len(numbers):
            docs.append(numbers)
            y.append(label)
    words = list(vocab)
    y = np.array(y, np.int64)
    test = rng.random(len(y)) < 0.2
    if len(set(y[~test].tolist())) < 2:
        return start_parameters(np.zeros(WORD_BUCKETS + CHAR_BUCKETS), seed)
    fitted = [d for d, x in zip(docs, test, strict=True) if not x]
    p = start_parameters(bucket_odds(fitted, y[~test], word_buckets(words)), seed)
    strength = np.concatenate([vectors(p, word_buckets(words[i : i + 8192]))[:, -1] for i in range(0, len(words), 8192)])
    if not odds:  # they still say which window each text starts with
        p["L"][:] = 0
    windows = [[d[a:b] for a, b in cut(len(d))] for d in fitted]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k != "L"}
    step = 0
    for number in range(rounds):
        # Each text's window with the highest score (at first: the highest log-odds), and another of clean texts.
        flat_windows = [w for own in windows for w in own]
        scores = window_logits(p, flat_windows, words) if number else np.array([strength[w].max() for w in flat_windows])
        chosen, target, at = [], [], 0
        for own, label in zip(windows, y[~test], strict=True):
            best = int(scores[at : at + len(own)].argmax())
            at += len(own)
            pick = [best] if label or len(own) == 1 else [best, int(rng.integers(len(own)))]
            chosen += [own[j] for j in pick]
            target += [label] * len(pick)
        target = np.array(target, np.float32)
        share = target.mean()
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
            step += 1
            index, mask = pack([chosen[i] for i in part])
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            buckets = word_buckets([words[i] for i in used])
            x = vectors(p, buckets)
            logit, saved = forward(p, local, {d: x @ p[f"W{d}"] + p[f"B{d}"] for d in "fb"}, mask, keep=True)
            balance = np.where(target[part] > 0, 0.5 / share, 0.5 / (1 - share))
            d_logit = ((sigmoid(logit) - target[part]) * balance / len(part)).astype(np.float32)
            g, d_gates = backward(p, d_logit, local, mask, saved)
            d_x = np.zeros_like(x)
            by_word = np.argsort(local, axis=None, kind="stable")
            firsts = np.searchsorted(local.ravel()[by_word], np.arange(len(used)))
            for d in "fb":
                sums = np.add.reduceat(d_gates[d].reshape(-1, 3 * HIDDEN)[by_word], firsts, axis=0)
                g[f"W{d}"] = x.T @ sums
                d_x += sums @ p[f"W{d}"].T
            flat, owner, weight = flattened(buckets)
            by_bucket = np.argsort(flat, kind="stable")
            rows, firsts = np.unique(flat[by_bucket], return_index=True)
            d_e = np.add.reduceat((d_x[:, :WIDTH].take(owner, axis=0) * weight[:, None])[by_bucket], firsts, axis=0)
            for k, (m, v) in moments.items():
                at_rows = rows if k == "E" else slice(None)
                grad = d_e if k == "E" else g[k].reshape(p[k].shape)
                m[at_rows] = 0.9 * m[at_rows] + 0.1 * grad
                v[at_rows] = 0.99 * v[at_rows] + 0.01 * grad**2
                p[k][at_rows] -= rate * (m[at_rows] / (1 - 0.9**step)) / (np.sqrt(v[at_rows] / (1 - 0.99**step)) + 1e-6)
    held = [i for i in range(len(y)) if test[i]]
    if len(set(y[held].tolist())) == 2:
        own = [[docs[i][a:b] for a, b in cut(len(docs[i]))] for i in held]
        scores = window_logits(p, [w for x in own for w in x], words)
        firsts = np.cumsum([0] + [len(x) for x in own[:-1]])
        best = np.maximum.reduceat(scores, firsts)
        order = np.argsort(-best, kind="stable")
        hits = np.cumsum(y[held][order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + hits[-1])
        k = int(f1.argmax())
        above = best[order[k]]
        below = best[order[k + 1]] if k + 1 < len(order) else above - 1
        p["c"] = p["c"] - np.float32((above + below) / 2)
    return p


def fit(spark_docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, odds: bool = True) -> dict:
    """A network from labelled rows outside the held-out fold: of each label the ``texts`` ids with
    the smallest hash. Whole texts are learned from and set the level, as scoring takes whole texts.

    Ids with both labels, and labels whose document is missing or whose id is null, teach nothing and
    use up no place; of several texts of one id the least counts. A null text has no words. Without
    rows of both labels the network is untrained. ``odds`` off leaves the log-odds inputs at 0."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_kv_high"))
    rows = rows.where("toxic = _kv_high").select("doc_id", "toxic").join(spark_docs.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [rows.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(texts) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice ``texts`` rows
    got = spark_docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in got], [r["toxic"] for r in got], odds=odds)


def scorer(p: dict, block: int = 1024, chars: int = 2_000_000):
    """text -> SCORE as a column function: the highest window's score, its first word, the windows.

    Texts are worked on in parts of about ``chars`` characters, so memory is bounded by that or by
    the longest text."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[bytes, int] = {}
        tables = {d: np.empty((0, 3 * HIDDEN), np.float32) for d in "fb"}
        steps = np.arange(WINDOW)[:, None]

        def part(texts: list[str | None]):
            """Scores, places and numbers of windows of a bounded amount of text."""
            nonlocal tables
            values = [text_words(t) for t in texts]
            if len(memo) > 100_000:
                memo.clear()
                tables = {d: x[:0] for d, x in tables.items()}
            new = list(dict.fromkeys(w for words in values for w in words if w not in memo))
            more = project(p, new, halved=True)
            tables = {d: np.concatenate([tables[d], more[d]]) for d in "fb"}
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            lengths = np.fromiter(map(len, values), np.int64, len(values))
            numbers = np.fromiter((memo[w] for words in values for w in words), np.int64, int(lengths.sum()))
            starts = np.cumsum(lengths) - lengths
            windows = [(i, a, b - a) for i, n in enumerate(lengths) if n for a, b in cut(int(n))]
            owner, first, size = np.array(windows, np.int64).reshape(-1, 3).T
            found = np.empty(len(owner), np.float32)
            for i in range(0, len(owner), block):
                o, f, s = owner[i : i + block], first[i : i + block], size[i : i + block]
                mask = (steps < s).astype(np.float32)
                index = numbers[starts[o] + f + np.minimum(steps, s - 1)]
                found[i : i + block] = logits(p, index, tables, mask)
            count = np.bincount(owner, minlength=len(values)).astype(np.int32)
            best = np.zeros(len(values))
            place = np.zeros(len(values), np.int32)
            some = np.flatnonzero(count)
            if len(some):
                begin = (np.cumsum(count) - count)[some]
                best[some] = sigmoid(np.clip(np.maximum.reduceat(found, begin).astype(np.float64), -30, 30))
                order = np.lexsort((first, -found, owner))
                place[some] = first[order[begin]]
            return best, place, count

        for batch in batches:
            done, texts, room = [], [], chars
            for value in batch:
                text = value.as_py()
                texts.append(text)
                room -= len(text or "")
                if room <= 0:
                    done.append(part(texts))
                    texts, room = [], chars
            if texts or not done:
                done.append(part(texts))
            best, place, count = (np.concatenate(x) for x in zip(*done, strict=True))
            yield pa.StructArray.from_arrays([pa.array(best, pa.float64()), pa.array(place, pa.int32()), pa.array(count, pa.int32())], names=["score", "start", "n_windows"])

    return F.arrow_udf(score, SCORE).asNondeterministic()


def score_toxicity(docs: DataFrame, network: dict) -> DataFrame:
    """``docs`` with ``toxicity``: score (0 to 1), first word of the highest window, windows.

    Every word of every text is in a window. Null and empty texts have score 0 and no window; rows
    are independent, so equal rows have equal scores; a column toxicity is replaced; an empty table
    gives an empty table."""
    return docs.withColumn("toxicity", scorer(network)("text"))


def drop_toxic(docs: DataFrame, network: dict, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with the columns of ``docs`` (also one named toxicity).

    Null and empty texts score 0 and stay."""
    own = "toxicity" in docs.columns
    plain = docs.withColumnRenamed("toxicity", "_kv_toxicity") if own else docs
    kept = score_toxicity(plain, network).where(F.col("toxicity.score") < limit).drop("toxicity")
    return kept.withColumnRenamed("_kv_toxicity", "toxicity") if own else kept


def op6_toxicity_gru(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("toxicity.score")
    return score_toxicity(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
