"""Secret scan: fixed patterns, and a character convolutional network over further candidates.

Base findings are matches of three patterns and always stay. Candidates are runs of at least
``LEAST_RUN`` key characters, without what belongs to a base finding. The network reads each in parts: the
whole, the pieces between / and =, and windows of ``HEAD`` characters every ``STEP`` in those that are longer,
each with its surroundings (``LEFT`` characters before, ``RIGHT`` behind). A candidate with a part over the
threshold is added as kind ``model``. The network is trained in numpy on findings that ``labelled_findings``
and ``deep_findings`` make from a seed, and the threshold is the largest that keeps ``RECALL`` of the secrets
among held-out findings.

Spans are in code points, end exclusive. Cases: null and empty texts have no findings; repeated rows get
equal results; the span of a candidate is all of it, also where one part of it was over the threshold; an empty
table gives no rows; other columns stay as they are."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import vec
from shelfspark.llm.vec import column

# The patterns of the base findings
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24       # hex: runs of 0-9 and a-f
LEAST_RUN, LEFT, HEAD, RIGHT, STEP = 16, 24, 40, 8, 20
RECALL = 0.95
WIDTH = LEFT + HEAD + RIGHT

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_PIECE = re.compile(rb"[^/=]+")

#: What the network sees of a byte: letters in both cases, digits, marks; all else is one class.
_SEEN = "\0abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n:=\"'+/_.-@,;&?#()<>"
_CLASS = np.full(256, len(_SEEN), np.int64)
_CLASS[[ord(c) for c in _SEEN]] = np.arange(len(_SEEN))
CLASSES, DIM, KERNEL, FILTERS = len(_SEEN) + 1, 8, 5, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found


def _long_runs(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of ``inside`` of at least ``least`` bytes that do not leave their row."""
    if not len(buf):
        return np.zeros(0, int), np.zeros(0, int)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = e - s >= least
    return s[keep], e[keep]


_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def _window(raw: bytes, s: int, e: int) -> np.ndarray:
    """Classes of the candidate and its surroundings; what lies outside the text is class 0."""
    left, head, right = raw[max(0, s - LEFT): s], raw[s: min(e, s + HEAD)], raw[e: e + RIGHT]
    return _CLASS[np.frombuffer(left.rjust(LEFT, b"\0") + head.ljust(HEAD, b"\0") + right.ljust(RIGHT, b"\0"), np.uint8)]


def _parts(raw: bytes, s: int, e: int) -> list[tuple[int, int]]:
    """What the network reads of a candidate: every character is in a part of at most ``HEAD``."""
    long = [(s, e)] + [(s + m.start(), s + m.end()) for m in _PIECE.finditer(raw[s:e]) if m.end() - m.start() >= LEAST_RUN]
    steps = [(t, min(t + HEAD, y)) for x, y in long for t in range(x + STEP, y - HEAD + STEP, STEP)]
    return list(dict.fromkeys(long + steps))


def _outside(i: int, j: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of i..j of at least ``LEAST_RUN`` that no span touches."""
    out = []
    for x, y in sorted((x, y) for x, _, y in spans if x < j and y > i) + [(j, j)]:
        if x - i >= LEAST_RUN:
            out.append((i, x))
        i = max(i, y)
    return out


# ---- the network -------------------------------------------------------------------------------

def _forward(p: dict, x: np.ndarray):
    n = len(x)
    emb = p["emb"][x]                                                     # n, WIDTH, DIM
    steps = WIDTH - KERNEL + 1
    cols = np.stack([emb[:, i: i + steps] for i in range(KERNEL)], 2).reshape(n, steps, KERNEL * DIM)
    act = np.maximum(cols @ p["conv"] + p["cb"], 0)
    parts = (act[:, : LEFT - KERNEL + 1], act[:, LEFT - KERNEL + 1:])       # before the candidate; from it on
    top = [a.argmax(1) for a in parts]
    pooled = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for a, t in zip(parts, top, strict=True)] + [parts[1].mean(1)], 1)
    return cols, act, top, pooled, 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["ob"], -30, 30)))


def _train(x: np.ndarray, y: np.ndarray, seed: int, epochs: int, rate: float = 0.004) -> dict:
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.3, (CLASSES, DIM)), "conv": rng.normal(0, 0.2, (KERNEL * DIM, FILTERS)), "cb": np.zeros(FILTERS),
         "out": rng.normal(0, 0.2, 3 * FILTERS), "ob": np.zeros(1)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    cut = LEFT - KERNEL + 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            xb, yb = x[order[i: i + 64]], y[order[i: i + 64]]
            cols, act, top, pooled, prob = _forward(p, xb)
            n, steps = act.shape[:2]
            d = (prob - yb) / n
            g = {"out": pooled.T @ d, "ob": d.sum(keepdims=True)}
            dp = d[:, None] * p["out"]
            da = np.zeros_like(act)
            rows, f = np.arange(n)[:, None], np.arange(FILTERS)[None]
            da[rows, top[0], f] += dp[:, :FILTERS]
            da[rows, cut + top[1], f] += dp[:, FILTERS: 2 * FILTERS]
            da[:, cut:] += dp[:, None, 2 * FILTERS:] / (steps - cut)
            da *= act > 0
            g["conv"] = np.tensordot(cols, da, ((0, 1), (0, 1)))
            g["cb"] = da.sum((0, 1))
            dc = (da @ p["conv"].T).reshape(n, steps, KERNEL, DIM)
            de = np.zeros((n, WIDTH, DIM))
            for k in range(KERNEL):
                de[:, k: k + steps] += dc[:, :, k]
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], xb, de)
            t += 1
            for k in p:                                                     # Adam
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return p


class Scanner:
    def __init__(self, params: dict, threshold: float):
        self.params, self.threshold = {k: a.astype(np.float32) for k, a in params.items()}, threshold

    def score(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([_forward(self.params, windows[i: i + 256])[-1] for i in range(0, len(windows), 256)]) if len(windows) else np.zeros(0)

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Sorted (start, kind, end) of each text, kind by its place in KINDS."""
        out = []
        for lo, hi, buf, offs in vec.slices(texts):
            raw = texts.slice(lo, hi - lo).to_pylist()
            spans = [base_spans(t) if t else [] for t in raw]
            whole = buf.tobytes()

            point = np.concatenate([[0], np.cumsum(buf & 0xC0 != 0x80)])           # code points before each byte

            def runs(inside, least):
                s, e = _long_runs(buf, offs, inside, least)
                row = np.searchsorted(offs, s, "right") - 1
                return zip(*(x.tolist() for x in (row, s, point[s] - point[offs[row]], point[e] - point[offs[row]])), strict=True)

            for row, _, i, j in runs(_HEX[buf], LEAST_HEX):
                spans[row].append((i, 2, j))
            rows, windows, of = [], [], []
            for row, start, first, last in runs(_RUN[buf], LEAST_RUN):
                for i, j in _outside(first, last, spans[row]):                     # a run is ASCII: a byte is a code point
                    a = start + i - first
                    begin, end = max(int(offs[row]), a - LEFT), min(int(offs[row + 1]), a + j - i + RIGHT)
                    near = whole[begin:end]
                    parts = _parts(near, a - begin, a - begin + j - i)
                    windows += [_window(near, x, y) for x, y in parts]
                    of += [len(rows)] * len(parts)
                    rows.append((row, i, j))
            best = np.zeros(len(rows))
            np.maximum.at(best, of, self.score(np.array(windows, np.int64).reshape(-1, WIDTH)))
            for k in np.flatnonzero(best >= self.threshold).tolist():
                row, i, j = rows[k]
                spans[row].append((i, 3, j))
            out += [sorted(x) for x in spans]
        return out


# ---- labelled findings --------------------------------------------------------------------------

# How the findings are written
_KEY_PREFIX = ("", "", "", "ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "glpat-", "npm_", "AIza", "eyJhbGciOiJIUzI1NiJ9", "sq0atp-", "SG", "pk-", "hf_")
_KEY_CONTEXT = ("key = ", "auth: ", "Authorization: Bearer ", "credential=", "export ACCESS=", "private_key: ", "client_id ", " pwd ", "login with ", "use ", "", "aws ", "\"cred\": \"", "set ")
_PLAIN_CONTEXT = ("see ", "order ", "commit ", "https://example.com/", "version ", "file ", "id ", "page ", "the ", "part ", "model ", "", "ref=", "/usr/lib/", "and ", "img/")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LETTERS + _LETTERS.upper() + "0123456789"


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) of ``n`` findings and whether each is a secret, half and half, made by rule from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))                                         # noqa: E731
    word = lambda: pick(_LETTERS, int(rng.integers(2, 9)))                                              # noqa: E731
    plain = (lambda: "-".join(word() for _ in range(rng.integers(3, 7))) + f"-{rng.integers(1, 2030)}",       # slug
             lambda: f"20{rng.integers(10, 30)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}-{word()}-{word()}",
             lambda: "/".join(word() for _ in range(rng.integers(3, 6))) + f"/{rng.integers(1, 9999)}",
             lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),                        # record id
             lambda: "_".join(word() for _ in range(rng.integers(3, 6))) + f"_v{rng.integers(1, 99)}",
             lambda: word().upper() + "-" + "-".join(pick("0123456789", 4) for _ in range(3)),
             lambda: word() + "=" + pick("0123456789", 4) + "/" + word() + "=" + word() + pick("0123456789", 6),
             lambda: "".join(word() for _ in range(4)) + pick("0123456789", 2))
    out, label = [], np.arange(n) % 2
    for y in label:
        if y:
            value = str(rng.choice(_KEY_PREFIX)) + pick(_MIXED + ("+/" if rng.random() < 0.3 else ""), int(rng.integers(20, 44)))
            value += str(rng.integers(10)) + pick(_LETTERS, 1)
            near = str(rng.choice(_KEY_CONTEXT))
        else:
            value = plain[rng.integers(len(plain))]()
            value += "x1" + pick(_LETTERS, max(0, LEAST_RUN - len(value)))
            near = str(rng.choice(_PLAIN_CONTEXT))
        before = " ".join(word() for _ in range(rng.integers(0, 5))) + " " + near
        out.append((before + value + str(rng.choice(["", " ", "\n", "\" ", ". "])) + " ".join(word() for _ in range(2)), len(before), len(before) + len(value)))
    return out, label


def deep_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, start of the secret, its end) of ``n`` runs: half hold a secret at any depth, half none (empty secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))                                         # noqa: E731
    word = lambda most=9: pick(_LETTERS, int(rng.integers(2, most)))                                    # noqa: E731
    plain = (word, word, lambda: "-".join(word() for _ in range(rng.integers(2, 7))), lambda: str(rng.integers(1, 10 ** 9)),
             lambda: pick(_LETTERS.upper(), 1) + pick("0123456789", 8), lambda: "_".join(word() for _ in range(rng.integers(2, 5))),
             lambda: word(26), lambda: word().capitalize() + word(20), lambda: word(24).upper(), lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
             lambda: "=".join(word() for _ in range(2)), lambda: word(30).upper(), lambda: word()[:4] * int(rng.integers(4, 9)), lambda: word(3)[:1] * int(rng.integers(16, 60)),
             lambda: pick("0123456789abcdef", int(rng.integers(24, 41))) + "_", lambda: "AKIA" + pick(_LETTERS.upper() + "0123456789", 16))     # base findings
    out = []
    for i in range(n):
        before = [plain[rng.integers(len(plain))]() for _ in range(rng.integers(0, 7))]
        after = [plain[rng.integers(len(plain))]() for _ in range(rng.integers(0, 3))]
        head, tail = ("".join(p + str(rng.choice(["/", "/", "="])) for p in before), "".join("/" + p for p in after))
        letters = _MIXED if rng.random() < 0.7 else _LETTERS + _LETTERS.upper()                         # also without digits
        value = pick(letters, int(rng.integers(20, 44))) if i % 2 else plain[rng.integers(len(plain))]()
        if i % 2 == 0 and rng.random() < 0.4:                                                          # a long word alone
            head, tail, value = "", "", pick(_LETTERS, int(rng.integers(16, 34)))
            value = (value, value.upper(), value.capitalize())[rng.integers(3)]
        run = head + value + tail
        run += pick(_LETTERS, max(0, LEAST_RUN - len(run)))
        left = " ".join(word() for _ in range(rng.integers(0, 5))) + str(rng.choice([" ", " see ", " https://example.com/", " (", "\n"]))
        s = len(left) + len(head)
        out.append((left + run + str(rng.choice(["", " ", "\n", ". ", ", "])) + word(), len(left), len(left) + len(run), s, s + len(value) * (i % 2)))
    return out


def _deep_windows(findings: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all parts, the finding of each, and how many characters of its secret the network sees there."""
    x, of, seen = [], [], []
    for k, (t, s, e, a, b) in enumerate(findings):
        for i, j in _parts(t.encode(), s, e):
            x.append(_window(t.encode(), i, j)), of.append(k), seen.append(max(0, min(j, b, i + HEAD) - max(i, a)))
    return np.array(x), np.array(of), np.array(seen)


def train(n: int = 2400, seed: int = 11, epochs: int = 6) -> Scanner:
    """Network and threshold from ``n`` labelled findings and as many deep ones, a quarter of them held out for the threshold."""
    findings, y = labelled_findings(n, seed)
    x = np.array([_window(t.encode(), s, e) for t, s, e in findings])
    cut = 3 * n // 4
    deep = deep_findings(n, seed + 1)
    parts, _, seen = _deep_windows(deep[:cut])
    sure = (seen == 0) | (seen >= LEAST_RUN)                                # a part with a bit of a secret teaches nothing
    params = _train(np.concatenate([x[:cut], parts[sure]]), np.concatenate([y[:cut], seen[sure] > 0]).astype(float), seed, epochs)
    held = Scanner(params, 0.5)
    parts, of, seen = _deep_windows(deep[cut:])
    best, holds = np.zeros(n - cut), np.array([b > a for *_, a, b in deep[cut:]])
    np.maximum.at(best, of, held.score(parts))
    secret = np.sort(np.concatenate([held.score(x[cut:])[y[cut:] == 1], best[holds]]))
    return Scanner(params, float(secret[int((1 - RECALL) * len(secret))]))


def find_secrets(docs: DataFrame, scanner: Scanner, text: str = "text", to: str = "findings") -> DataFrame:
    """``docs`` with the array of findings (kind, start, end) of ``text``, sorted, in place of a column so named."""
    vec.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    names = [c for c in docs.columns if c != to]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("array<struct<kind:string,start:long,end:long>>").alias(to)).schema

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in sent.value.scan(column(b, text))]
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in names], pa.array(found, kind)], names=[*names, to])

    return docs.mapInArrow(run, schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = find_secrets(docs, train()).select("doc_id", "findings")
    of = lambda kind: F.filter("findings", lambda f: f["kind"] == kind)                                  # noqa: E731
    said = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(said(F.filter("findings", lambda f: f["kind"] != "model")).cast("binary"), 256).alias("base_sha256"),
                        said(F.col("findings")).alias("spans"))
