"""Character-level bidirectional LSTM with CRF transitions, in numpy: encoding, inference and gradients.

One direction reads `pre = table[char] + h @ rec + b` with the gates input, forget, output, cell side by side;
the sigmoid gates are computed as tanh of half their input, so that one tanh call serves all four.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "name", "address", "id_number")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
N_TAGS = len(TAGS)
PAD, BOS, EOS, NEWLINE, TAB, LETTER, SYMBOL = range(7)
DIGIT = 7
ASCII0 = 8
N_CHARS = ASCII0 + 95

_IDS = np.full(0x110000, SYMBOL, dtype=np.uint8)
_IDS[0xC0:0x2000] = LETTER
_IDS[0x3040:0xE000] = LETTER
_IDS[32:127] = np.arange(ASCII0, ASCII0 + 95)
_IDS[ord("3") : ord("9") + 1] = DIGIT
_IDS[10] = NEWLINE
_IDS[13] = TAB
_IDS[9] = TAB


def char_ids(text: str) -> np.ndarray:
    return _IDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Keeps numpy's matrix products in the calling thread; whether it could be arranged.

    A task has a core of its own. Products as small as these, spread over threads by the library behind numpy, cost twice
    the CPU time on two threads and far more where all cores are busy, and a library that is loaded reads no environment.
    """
    done = False
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
    return done


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions that BIO permits, and permitted first tags."""
    a = np.zeros((N_TAGS, N_TAGS), dtype=bool)
    for i, s in enumerate(TAGS):
        for j, t in enumerate(TAGS):
            a[i, j] = not t.startswith("I-") or (s != "O" and s[2:] == t[2:])
    return a, np.array([not t.startswith("I-") for t in TAGS])


ALLOWED, ALLOWED_FIRST = _allowed()


def init_params(hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"table_{d}"] = (r.standard_normal((N_CHARS, 4 * hidden)) * 0.25).astype(np.float32)
        p[f"rec_{d}"] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[f"bias_{d}"] = np.zeros(4 * hidden, dtype=np.float32)
        p[f"bias_{d}"][hidden : 2 * hidden] = 1.0
    p["out_w"] = (r.standard_normal((2 * hidden, N_TAGS)) / np.sqrt(2 * hidden)).astype(np.float32)
    p["out_b"] = np.zeros(N_TAGS, dtype=np.float32)
    p["trans"] = np.zeros((N_TAGS, N_TAGS), dtype=np.float32)
    return p


def lstm(ids: np.ndarray, table: np.ndarray, rec: np.ndarray, bias: np.ndarray, keep: bool = False):
    """ids (T, B) -> hidden states (T, B, H); with `keep` also what the gradient needs."""
    t_len, n = ids.shape
    h4 = rec.shape[1]
    hid = h4 // 4
    scale = np.full(h4, 0.5, dtype=np.float32)
    scale[3 * hid :] = 1.0
    table, rec = (table + bias) * scale, np.ascontiguousarray(rec * scale)
    h = np.zeros((n, hid), dtype=np.float32)
    c = np.zeros((n, hid), dtype=np.float32)
    out = np.empty((t_len, n, hid), dtype=np.float32)
    gates = np.empty((t_len, n, h4), dtype=np.float32) if keep else None
    cells = np.empty((t_len, n, hid), dtype=np.float32) if keep else None
    g = np.empty((n, h4), dtype=np.float32)
    tc = np.empty((n, hid), dtype=np.float32)
    for t in range(t_len):
        np.matmul(h, rec, out=g)
        g += table[ids[t]]
        np.tanh(g, out=g)
        s = g[:, : 3 * hid]
        s *= 0.5
        s += 0.5
        c = g[:, hid : 2 * hid] * c
        c += g[:, :hid] * g[:, 3 * hid :]
        np.tanh(c, out=tc)
        h = np.multiply(g[:, 2 * hid : 3 * hid], tc, out=out[t])
        if keep:
            gates[t], cells[t] = g, c
    return (out, gates, cells) if keep else out


def emissions(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """(T, B) ids -> (T, B, tags) scores; padding sits behind the text, so the backward reader starts on it."""
    one_thread()
    hid = p["rec_f"].shape[0]
    f = lstm(ids, p["table_f"], p["rec_f"], p["bias_f"])
    e = f.reshape(-1, hid) @ p["out_w"][:hid]
    del f
    b = lstm(ids[::-1], p["table_b"], p["rec_b"], p["bias_b"])[::-1]
    e += b.reshape(-1, hid) @ p["out_w"][hid:]
    e += p["out_b"]
    return e.reshape(*ids.shape, N_TAGS)


def viterbi(p: dict[str, np.ndarray], em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tag paths of several sequences at once: em (T, B, tags), lengths (B,) ascending -> (T, B) tags, 0 behind the end.

    An inner tag follows only its own opening or inner tag, so it has two ways in; the others have all tags' ways in.
    """
    t_len, n, k = em.shape
    free = np.array([j for j in range(k) if ALLOWED_FIRST[j]])  # outside and opening tags
    inner = np.array([j for j in range(k) if not ALLOWED_FIRST[j]])
    into = np.ascontiguousarray(p["trans"][:, free].T).astype(np.float32)  # (to, from)
    opened, kept = p["trans"][inner - 1, inner], p["trans"][inner, inner]
    score = em[0] + np.where(ALLOWED_FIRST, 0, np.float32(-1e4))
    back = np.zeros((t_len, n, k), dtype=np.uint8)
    first = np.searchsorted(lengths, np.arange(t_len), side="right")  # sequences before this one have ended
    for t in range(1, t_len):
        f = first[t]
        s = score[f:]
        m = s[:, None, :] + into
        way = m.argmax(2)
        new = np.empty_like(s)
        new[:, free] = np.take_along_axis(m, way[:, :, None], 2)[:, :, 0]
        a, b = s[:, inner - 1] + opened, s[:, inner] + kept
        new[:, inner] = np.maximum(a, b)
        back[t, f:, free] = way.T
        back[t, f:, inner] = np.where(a >= b, inner - 1, inner).T
        score[f:] = new + em[t, f:]
    tags = np.zeros((t_len, n), dtype=np.uint8)
    best = score.argmax(1).astype(np.uint8)
    rows = np.arange(n)
    for t in range(t_len - 1, -1, -1):
        f = first[t]
        tags[t, f:] = best[f:]
        if t:
            best[f:] = back[t, rows[f:], best[f:]]
    return tags


def loss_and_grads(p: dict[str, np.ndarray], ids: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood a character of full windows and its gradients. ids, gold (T, B)."""
    t_len, n = ids.shape
    hid = p["rec_f"].shape[0]
    f, fg, fc = lstm(ids, p["table_f"], p["rec_f"], p["bias_f"], True)
    br, bg, bc = lstm(ids[::-1], p["table_b"], p["rec_b"], p["bias_b"], True)
    h = np.concatenate([f, br[::-1]], 2)
    em = (h.reshape(-1, 2 * hid) @ p["out_w"] + p["out_b"]).reshape(t_len, n, N_TAGS).astype(np.float64)
    trans = np.where(ALLOWED, p["trans"], -1e4).astype(np.float64)
    inside = (np.arange(t_len)[:, None] < lengths[None])
    alpha = np.empty_like(em)
    alpha[0] = em[0] + np.where(ALLOWED_FIRST, 0, -1e4)
    for t in range(1, t_len):
        m = alpha[t - 1][:, :, None] + trans
        x = m.max(1)
        a = x + np.log(np.exp(m - x[:, None]).sum(1)) + em[t]
        alpha[t] = np.where(inside[t][:, None], a, alpha[t - 1])
    x = alpha[-1].max(1)
    z = x + np.log(np.exp(alpha[-1] - x[:, None]).sum(1))
    beta = np.zeros((n, N_TAGS))
    d_em = np.zeros_like(em)
    d_tr = np.zeros((N_TAGS, N_TAGS))
    for t in range(t_len - 1, -1, -1):
        d_em[t] = np.exp(np.minimum(alpha[t] + beta - z[:, None], 0)) * inside[t][:, None]
        if t:
            m = (em[t] + beta)[:, None, :] + trans
            pair = np.exp(np.minimum(alpha[t - 1][:, :, None] + m - z[:, None, None], 0)) * inside[t][:, None, None]
            d_tr += pair.sum(0)
            x = m.max(2)
            b = x + np.log(np.exp(m - x[:, :, None]).sum(2))
            beta = np.where(inside[t][:, None], b, beta)
    cols = np.arange(n)[None]
    gold_score = (np.take_along_axis(em, gold[:, :, None].astype(int), 2)[:, :, 0] * inside).sum()
    gold_score += (trans[gold[:-1], gold[1:]] * inside[1:]).sum()
    total = float(inside.sum())
    loss = (z.sum() - gold_score) / total
    d_em[np.arange(t_len)[:, None], cols, gold] -= inside
    np.subtract.at(d_tr, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    d_em = (d_em / total).astype(np.float32)
    g = {"trans": np.where(ALLOWED, d_tr / total, 0).astype(np.float32)}
    flat = d_em.reshape(-1, N_TAGS)
    g["out_w"] = h.reshape(-1, 2 * hid).T @ flat
    g["out_b"] = flat.sum(0)
    d_h = (flat @ p["out_w"].T).reshape(t_len, n, 2 * hid)
    for d, x_ids, gates, cells, hs, dh in (("f", ids, fg, fc, f, d_h[:, :, :hid]), ("b", ids[::-1], bg, bc, br, d_h[::-1, :, hid:])):
        rec_t = p[f"rec_{d}"].T
        dg = np.empty_like(gates)
        dc = np.zeros((n, hid), dtype=np.float32)
        dh_next = np.zeros((n, hid), dtype=np.float32)
        for t in range(t_len - 1, -1, -1):
            i, fo, o, u = (gates[t][:, k * hid : (k + 1) * hid] for k in range(4))
            th = np.tanh(cells[t])
            dht = dh[t] + dh_next
            dc = dc + dht * o * (1 - th * th)
            prev = cells[t - 1] if t else 0.0
            q = dg[t]
            q[:, :hid] = dc * u * i * (1 - i)
            q[:, hid : 2 * hid] = dc * prev * fo * (1 - fo)
            q[:, 2 * hid : 3 * hid] = dht * th * o * (1 - o)
            q[:, 3 * hid :] = dc * i * (1 - u * u)
            dh_next = q @ rec_t
            dc = dc * fo
        flat_g = dg.reshape(-1, 4 * hid)
        before = np.concatenate([np.zeros((1, n, hid), np.float32), hs[:-1]]).reshape(-1, hid)
        g[f"rec_{d}"] = before.T @ flat_g
        g[f"bias_{d}"] = flat_g.sum(0)
        one = np.zeros((x_ids.size, N_CHARS), dtype=np.float32)
        one[np.arange(x_ids.size), x_ids.reshape(-1)] = 1
        g[f"table_{d}"] = one.T @ flat_g
    return loss, g
