"""Secret scan: fixed rules, and a character convolutional network over every candidate.

Candidates are the findings of the rules, all tokens of 8 and more characters that aren't plain words (they hold a digit, a
capital inside, a joining sign or an inner dot), quoted values, and what follows a word like key, pass or auth.
The network reads the candidate with the characters around it; its output is
calibrated on labelled findings it has not seen, and the threshold is the highest that still
finds ``RECALL`` of the labelled secrets among them. Findings of the rules always stay; candidates
that the network accepts and that don't touch one of those are added as kind ``neural``.

The labelled findings are made from rules by a seeded generator (``labelled_findings``), as
the tables hold none; so the model is the same in every run and needs no pass over the data.

Defined results: null texts count as empty; positions are code points, ends exclusive; rows are
independent, so ties, repeated rows and null ids don't matter; texts are scanned whole, and
candidates of any length are read whole, in windows; of candidates that overlap the first, of those that start together the
longest counts; columns named as the results are replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match of [0-9a-f]+ is a maximal run, so its matches of 24 and more are those of {24,}.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further candidates: tokens that aren't plain words, quoted values, and what follows a word that announces a credential.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z][a-z]*(?:[A-Z0-9+/_=-]|\.[A-Za-z0-9])|[0-9+/_=-])[A-Za-z0-9+/_=.-]{7,}[A-Za-z0-9+/_=-]")
QUOTED = re.compile(r"[\"']([^\s\"']{8,64})[\"']")
ANNOUNCED = re.compile(r"(?:key|pass|pwd|auth|bearer|cred|secret|token|login|private)\w{0,16}[\"']?\s{0,2}[:=]?\s{0,2}[\"']?([^\s\"']{6,64})", re.I | re.A)
KINDS = ("assign", "access", "hex", "neural")
RECALL = 0.98
BEFORE, BODY, AFTER, WIDTH, FILTERS = 24, 64, 12, 4, 24
_PLAIN = string.ascii_letters + string.digits + "+/_=-.:\"' \n<>()[]{}@,;&?#%$!*~`|\\^"
_CODE = np.full(1 << 16, len(_PLAIN) + 1, np.int64)
_CODE[[ord(ch) for ch in _PLAIN]] = np.arange(1, len(_PLAIN) + 1)
ALPHABET = len(_PLAIN) + 2


@dataclass
class Net:
    table: np.ndarray  # WIDTH x (2 ALPHABET) x FILTERS: the convolution, over characters outside and inside the candidate
    base: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of the candidate with its context, in windows of equal length that cover the candidate."""
    out = []
    for at in range(start, max(end, start + 1), BODY):
        lo, hi = at - BEFORE, at + BODY + AFTER
        part = text[max(lo, 0) : hi]
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.zeros(hi - lo, np.int64)
        row[max(lo, 0) - lo : max(lo, 0) - lo + len(raw)] = _CODE[np.minimum(raw, (1 << 16) - 1)]
        row[max(start, at) - lo : min(end, hi) - lo] += ALPHABET
        out.append(row)
    return out


def _maps(x: np.ndarray, net: Net) -> np.ndarray:
    p = x.shape[1] - WIDTH + 1
    z = net.table[0][x[:, :p]]
    for j in range(1, WIDTH):
        z = z + net.table[j][x[:, j : j + p]]
    return z + net.base


def logits(x: np.ndarray, net: Net) -> np.ndarray:
    out = [np.maximum(_maps(x[lo : lo + 256], net).max(1), 0) @ net.out + net.bias for lo in range(0, len(x), 256)]
    return np.concatenate(out) if out else np.zeros(0)


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): made secrets in made contexts, and candidates of other kinds that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    digits = lambda k: draw(string.digits, k)
    between = lambda lo, hi: int(rng.integers(lo, hi))
    vowels, others = "aeiou" + "éàüö", "bcdfghjklmnprstvwzß"
    plain_vowels, plain_others = vowels[:5], others[:18]
    word = lambda most=5: "".join(pick(plain_others) + pick(plain_vowels) + pick(["", "", pick(plain_others)]) for _ in range(between(1, most)))
    # Frequent letter groups of a few languages.
    chunks = "th he in er an re on at nd st es en of te ed or ti hi as to le is ou ar ng ly ion tion ent ing ght sch ung que eur ait ell che ich der mente ción ado aux oi str rst nth lys".split()
    spelt = lambda: "".join(pick(chunks) for _ in range(between(2, 6))) if rng.random() < 0.6 else "".join(pick(others) + pick(vowels) for _ in range(between(1, 5)))
    prose = lambda: pick([str, str, str.upper, str.capitalize])(" ".join(pick([word, spelt])() for _ in range(between(2, 7))))
    full, url, hexes, caps = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", "0123456789abcdef", string.ascii_uppercase + string.digits
    # Introductions and prefixes in common use.
    intros = ["Authorization: Bearer ", "export KEY=", "key: ", "client_secret ", "auth_token=", "access key ", "credentials ", "private_key: ", "pw ", "apikey ", "x-api-key: ", "SECRET_KEY = '", "token \"", "pass=", "bearer "]
    logins = ["password is ", "pwd: ", "pass: ", "login / ", "passphrase = \"", "pass '", "PASSWORD ", "db_pass="]
    prefixes = ["", "", "", "sk_live_", "ghp_", "xoxb-", "pk_test_", "glpat-", "key-", "AKIA"]
    plain = ["see ", "file ", "version ", "at ", "order no ", "build ", "page ", "image ", "part ", "by ", "in ", "/", "chapter ", "", "", ""]
    topics = ["the key ", "a token ", "private ", "a secret ", "passed ", "passing ", "authors ", "authority ", "credit ", "login ", "keyboard ", "tokens: ", "keywords: ", "passengers ", "key "]
    pad = lambda t, k=8: t + "".join(word() for _ in range(9))[: max(0, k - len(t))]
    none = [
        lambda: "-".join([word(), word(), digits(2), word(), digits(4)]),
        lambda: "".join(word().capitalize() for _ in range(between(2, 5))) + pick(["", digits(2)]),
        lambda: f"IMG_20{digits(2)}{digits(4)}_{digits(6)}",
        lambda: "/".join([word(), word(), *(word() for _ in range(between(0, 4))), pick(["index.html", digits(4), word(), f"{word()}.{word(2)}"])]),
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}" + pick(["", f"T{digits(2)}-{digits(2)}-{digits(2)}Z"]),
        lambda: f"{word()}_{word()}_v{digits(1)}_{digits(2)}_{word()}",
        lambda: f"ISBN-{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}",
        lambda: pad(word() + word() + digits(between(1, 3))),
        lambda: ".".join(str(between(1, 256)) for _ in range(4)),
        lambda: pick([f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)}-{digits(3)}-{digits(6)}"]),
        lambda: digits(between(8, 21)),
        lambda: pick([word, spelt])().upper() + pick([word, spelt])().upper() + pick(["", "", digits(2)]),
        lambda: pad(spelt().upper() + spelt().upper()),
        lambda: f"{pick(['mail', 'www', word()])}{pick(['', digits(1)])}.{word()}.{pick(['com', 'org', 'net', 'de', 'fr'])}",
        lambda: pick([word().capitalize(), word().upper()]) + "-" + pick([word(), word().upper()]),
        lambda: f"{between(1, 30)}.{digits(2)}.{between(1990, 2030)}",
        lambda: f"{word()}.{pick(['pdf', 'jpg', 'txt', 'py', 'html'])}",
        lambda: f"{digits(between(1, 4))}.{digits(3)}.{digits(3)}",
        lambda: "".join(pick([str.upper, str.lower])(c) for c in word(3) + word(3) + word(3)) if rng.random() < 0.2 else word().capitalize() + word().capitalize(),
    ]
    out = []
    for i in range(n):
        label = i % 2
        if label:
            kind = rng.random()
            if kind < 0.75:
                body = pick(prefixes) + draw(pick([full, url, hexes, caps, full + "+/"]), between(16, 56)) + pick(["", "", "", "=", "=="])
                head = pick(intros) if rng.random() < 0.8 else ""
            elif kind < 0.85:
                body = "eyJ" + draw(url, between(12, 30)) + "." + draw(url, between(16, 40)) + "." + draw(url, between(16, 40))
                head = pick(intros) if rng.random() < 0.8 else ""
            else:
                body = pick([lambda: word().capitalize() + digits(between(2, 5)) + pick(["!", "#", "$", "_", "%"]) + draw(full, 3), lambda: draw(full + "!#$%&*", between(8, 16)), lambda: word() + pick(["_", "-", ".", "!"]) + digits(4)])()
                head = pick(logins)
        else:
            topic = rng.random()
            body = pick(none)() if topic > 0.25 else pick([word(4) + word(4) + word(3), spelt() + spelt() + spelt()])
            body = pad(body, 6 if topic <= 0.25 else 8)
            head = pick(topics) if topic <= 0.25 else pick([*plain, f"{word()}.{digits(2)}@", "(" + digits(3) + ") ", "\"", "'"])
        left = prose() + pick([" ", "\n", ", ", ". ", "!! "]) + head
        if rng.random() < 0.1:
            left = left.upper()
            body = body.upper() if not label else body
        out.append((left + body + pick([" ", "\n", "' ", ", ", "\" ", ".\n", "!! "]) + prose(), len(left), len(left) + len(body), label))
    return out


@functools.lru_cache(maxsize=1)
def trained(n: int = 6000, epochs: int = 8, seed: int = 5) -> Net:
    """The network, fitted by Adagrad on three fifths of the findings, calibrated on one and with its threshold from the last."""
    found = labelled_findings(n)
    x = np.stack([windows(t, s, e)[0] for t, s, e, _ in found])
    y = np.array([f[3] for f in found])
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.1, (WIDTH, 2 * ALPHABET, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0)
    fold = np.arange(n) // 2 % 5
    fitting = np.flatnonzero(fold < 3)
    gt, go, gb = np.full_like(net.table, 1e-6), np.full(FILTERS, 1e-6), np.full(FILTERS, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(fitting)
        for lo in range(0, len(order), 64):
            take = order[lo : lo + 64]
            z = _maps(x[take], net)
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            h = np.maximum(top, 0)
            d = 1 / (1 + np.exp(-(h @ net.out + net.bias))) - y[take]
            dh = d[:, None] * net.out * (top > 0) / len(take)
            for j in range(WIDTH):
                g = np.zeros_like(net.table[j])
                np.add.at(g, (x[take[:, None], at + j], np.arange(FILTERS)), dh)
                gt[j] += g * g
                net.table[j] -= 0.1 * g / np.sqrt(gt[j])
            dbase, dout = dh.sum(0), h.T @ d / len(take)
            gb += dbase**2
            net.base -= 0.1 * dbase / np.sqrt(gb)
            go += dout**2
            net.out -= 0.1 * dout / np.sqrt(go)
            net.bias -= 0.05 * float(d.mean())
    z, t = logits(x[fold == 3], net), y[fold == 3]
    soft = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-(net.slope * z + net.shift)))
        net.slope -= 0.05 * float(((p - soft) * z).mean())
        net.shift -= 0.05 * float((p - soft).mean())
    last = np.sort(probabilities(x[(fold == 4) & (y == 1)], net))
    net.threshold = float(last[int(len(last) * (1 - RECALL))])
    return net


def probabilities(x: np.ndarray, net: Net) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * logits(x, net) + net.shift, -40, 40)))


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings in order."""
    low = text.lower() if len(text) >= 6 else ""
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates that touch no finding of the rules, in order and apart from each other."""
    made = {m.span() for m in TOKEN.finditer(text)}
    if '"' in text or "'" in text:
        made.update(m.span(1) for m in QUOTED.finditer(text))
    made.update(m.span(1) for m in ANNOUNCED.finditer(text))
    out, at, i = [], 0, 0
    base = sorted((s, e) for s, _, e in base)
    for s, e in sorted(made, key=lambda x: (x[0], -x[1])):
        while i < len(base) and base[i][1] <= s:
            i += 1
        if s >= at and not any(b < e and s < c for b, c in base[i : i + 3]):
            out.append((s, e))
            at = e
    return out


def scan(texts: list[str], net: Net) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]]:
    """For each text: the rules' findings, all findings, and the network's probability for each of the latter."""
    held, rows, owner = [], [], []
    for i, text in enumerate(texts):
        base = base_findings(text)
        held.append((base, [(s, 3, e) for s, e in tokens(text, base)]))
        for s, _, e in base + held[-1][1]:
            for w in windows(text, s, e):
                rows.append(w)
                owner.append((i, s, e))
    p: dict[tuple[int, int, int], float] = {}
    for lo in range(0, len(rows), 4096):
        for key, q in zip(owner[lo : lo + 4096], probabilities(np.stack(rows[lo : lo + 4096]), net)):
            p[key] = max(p.get(key, 0.0), float(q))
    out = []
    for i, (base, more) in enumerate(held):
        every = sorted(base + [f for f in more if p[(i, f[0], f[2])] >= net.threshold])
        out.append((base, every, [p[(i, s, e)] for s, _, e in every]))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


RESULT = "n_assign long, n_access long, n_hex long, n_neural long, base_sha256 string, spans string, probabilities array<double>, redacted string"


def find_secrets(df: DataFrame, text: str = "text", redact: bool = True) -> DataFrame:
    """df with n_assign, n_access, n_hex, n_neural, base_sha256, spans, probabilities and redacted (the text with each finding masked)."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    df = df.drop(*names)
    columns = df.columns
    net = trained()
    schema = StructType([*df.schema.fields, *StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(text).to_pylist()]
                made: list[list] = [[] for _ in names]
                for t, (base, every, p) in zip(texts, scan(texts, net)):
                    kinds = [k for _, k, _ in every]
                    masked = None
                    if redact:
                        at, pieces = 0, []
                        for s, k, e in every:
                            if s >= at:
                                pieces += [t[at:s], f"[{KINDS[k]}]"]
                            at = max(at, e)
                        masked = "".join([*pieces, t[at:]])
                    for column, value in zip(made, [*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), p, masked]):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(made, types))], names=[*columns, *names])

    return df.mapInArrow(run, schema)
