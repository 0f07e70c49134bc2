"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans (email, ip, card, phone). The random field reads every line as a
sequence of white-space tokens. A token's features are its shape (runs of capitals, small letters and
digits, digit runs by length, other signs as they are) and a few marks (length, mix of letters and
digits, key word before a secret, valid check digit, ...), each for the token itself and its two
neighbours. It is trained by maximum likelihood (forward-backward) on a small labelled table and
decoded by Viterbi, many lines at a time in numpy. It adds spans that no base span touches: secrets
(keys, tokens, passwords), and base kinds written in ways the patterns miss.

The labelled table has at most MAX_ROWS rows; `labelled_rows` writes one from a rule. Everything else
reads all documents, whole.

Plain sums, hashes and UUIDs are no secrets unless a key word stands before them. A very long line is decoded in
pieces, cut only after tokens that are outside of any span on every best path, which changes no label.

Defined results: a null or empty text has no spans; repeated rows give equal results; extra columns
are ignored; an empty table gives an empty table; a null doc_id stays null. Offsets are code points.
"""

from __future__ import annotations

import functools
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MAX_ROWS = 20_000
CACHE_WORDS = 500_000

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start; failing matches are dropped and not tried again."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # an address holds no white space, so the piece around a sign is enough
        a, b = at, at
        while a > done and not text[a - 1].isspace():
            a -= 1
        n = len(text)
        while b < n and not text[b].isspace():
            b += 1
        out += [("email", a + m.start(), a + m.end()) for m in EMAIL.finditer(text[a:b])]
        done = b
        at = text.find("@", b)
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# ---- features

RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7F]+|(.)\1*", re.S)
KEYWORDS = frozenset("token key secret password passwd pwd apikey api_key api-key access_key auth bearer credential credentials client_secret access_token auth_token private_key secret_key".split())
#: words before or in front of sums, which are no secrets
SUMS = frozenset("commit revision rev hash md5 sha1 sha256 sha-256 sha512 checksum digest etag uuid guid id build sum fingerprint blob tree parent version".split())
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
THREE = re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
KNOWN = re.compile(r"(AKIA|ASIA|sk-|sk_live_|pk_live_|gh[pousr]_|xox[abpr]-|glpat-|AIza|ya29\.)[A-Za-z0-9_-]{10,}")
HEX = re.compile(r"[0-9a-fA-F]{16,}")
MIXED = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


ALNUM = re.compile(r"[A-Za-z0-9]{8,}")


def _mixed(m: re.Match) -> str:
    x = m[0]
    return x if x.isdigit() or x.isalpha() else "\0"


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits; long runs of letters and digits together are one sign."""
    out = []
    for m in RUNS.finditer(ALNUM.sub(_mixed, token)):
        x = m[0]
        c = x[0]
        if c.isascii() and c.isdigit():
            n = len(x)
            out.append(f"d{n if n < 5 else 5 if n < 9 else 9 if n < 13 else 13 if n < 20 else 20}")
        elif "A" <= c <= "Z":
            out.append("X")
        elif "a" <= c <= "z" or not c.isascii():
            out.append("x")
        else:
            out.append(c)
        if len(out) > 12:
            out.append("~")
            break
    return "".join(out)


def features(token: str) -> tuple[str, ...]:
    """What the random field sees of a token."""
    core = token.strip("\"'.,;:!?()[]{}<>#$%&*|")
    if core.isalpha() and len(core) < 16:
        kind = "x" if core.islower() else "X" if core.isupper() else "Xx"
        word = ("keyword",) if core.lower() in KEYWORDS else ("sum",) if core.lower() in SUMS else ("word",)
        return (*word, f"s={kind}", f"end={token[-1] if not token[-1].isalpha() else ''}")
    out = [f"s={shape(core)}", f"len={min(len(core) // 4, 8)}"]
    low = core.lower()
    parts = re.split(r"[=:]", low)
    if any(p.strip("\"'") in KEYWORDS for p in parts[:-1]) or low in KEYWORDS:
        out.append("keyvalue" if len(parts[-1]) >= 8 else "keyword")
    if any(p.strip("\"'-") in SUMS for p in parts[:-1]) or low in SUMS:
        out.append("sum")
    if "=" in token or token.endswith(":"):
        out.append("assign")
    letters, digits = any(map(str.isalpha, core)), sum(c in string.digits for c in core)
    if digits:
        out.append("digits" if not letters else "alnum")
        flat = re.sub(r"[ -]", "", core)
        if flat.isascii() and flat.isdigit() and 13 <= len(flat) <= 19:
            out.append("luhn" if luhn(flat) else "noluhn")
        if core.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in core.split(".")):
            out.append("quad")
    if "@" not in core:
        out.append("noat")
    else:
        out.append("at" if "." in core.rpartition("@")[2] else "at-nodot")
    last = parts[-1].strip("\"'")
    whole = re.sub(r"^[\w.-]+[=:][\"']?", "", core)
    if UUID.fullmatch(last):
        out.append("uuid")
    elif KNOWN.fullmatch(whole):
        out.append("known")
    elif THREE.fullmatch(whole) and re.search("[0-9]", whole) and re.search("[A-Z]", whole):
        out.append("three")
    elif HEX.fullmatch(last) and re.search("[0-9]", last):
        out.append("hex")
    elif MIXED.fullmatch(last) and re.search("[0-9]", last) and re.search("[a-z]", last):
        out.append("mixed")
    if token[0] in "\"'":
        out.append("quoted")
    if token[0] == "+":
        out.append("plus")
    return tuple(out)


# ---- labelled table


def labelled_rows(n: int = 1600, seed: int = 7) -> list[tuple[int, list[str], list[str]]]:
    """A small labelled table made from a rule: (id, tokens, labels)."""
    r = random.Random(seed)
    syllables = "an the re in on er ti es or st en ha ou de la des que und sch heit mente ción ée ung tion ä ß ñ".split()

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        w = r.choice((w, w, w, w.capitalize(), w.upper()))
        return w + r.choice(("", "", "", "", ",", ".", ".", "!!", "###", "$$$", "%%%", "***", "&&&"))

    d = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    name = lambda k: "".join(r.choice(string.ascii_lowercase) for _ in range(k))

    def card() -> list[str]:
        body = d(r.choice((12, 14, 15, 15, 15, 18)))
        full = next(body + c for c in string.digits if luhn(body + c))
        if r.random() < 0.3:
            sep = r.choice(" -")
            return sep.join(full[i : i + 4] for i in range(0, len(full), 4)).split(" ")
        return [full]

    def phone() -> list[str]:
        return r.choice((f"+{d(r.randint(1, 2))} ({d(3)}) {d(3)}-{d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}")).split(" ")

    def uuid() -> str:
        h = "".join(r.choice("0123456789abcdef") for _ in range(32))
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    def sums() -> list[str]:
        """Sums and names that look like secrets and are none."""
        h = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 64))))
        word_ = r.choice(("commit", "revision", "hash", "md5", "sha1", "checksum", "digest", "tree", "parent", "Commit", "build"))
        return r.choice((lambda: [word_, h], lambda: [f"{word_}:", h], lambda: [f"sha256:{h}"], lambda: [f"{word_}={h}"], lambda: [uuid()], lambda: ["id", uuid()], lambda: ["uuid:", uuid()], lambda: [h], lambda: [f"({h[:7]})"], lambda: [h[:12]]))()

    def secret() -> tuple[list[str], list[str]]:
        hexa = lambda: r.choice((str.lower, str.lower, str.upper))("".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 64)))))
        part = lambda a, b: "".join(r.choice(string.ascii_letters + string.digits + "_-") for _ in range(r.randint(a, b)))
        three = lambda: f"eyJ{part(14, 30)}.eyJ{part(20, 60)}.{part(30, 44)}"
        known = lambda: r.choice(("ghp_", "xoxb-", "AIza", "glpat-", "sk_live_")) + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 36)))
        named = r.random() < 0.75  # a sum, a plain hexadecimal number or a UUID is a secret only after a key word
        make = r.choice((hexa, hexa, uuid, three, known)) if named and r.random() < 0.7 else r.choice((three, known)) if r.random() < 0.5 else None
        body = make() if make else r.choice((lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 44))), lambda: "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)), lambda: "sk-" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32))))()
        if r.random() < 0.1 and not make:
            body += "="
        key = r.choice(("token", "key", "secret", "password", "api_key", "apikey", "auth", "TOKEN", "API_KEY", "Password", "access_token", "client_secret"))
        q = r.choice(('"', '"', "'", ""))
        v = f"{q}{body}{q}"
        if not named:
            return [body], ["B-secret"]
        return r.choice((([key, "=", v], ["O", "O", "B-secret"]), ([f"{key}:", v], ["O", "B-secret"]), ([f"{key}={v}"], ["B-secret"])))

    def noise() -> list[str]:
        return r.choice(
            (
                lambda: [d(4)], lambda: [d(r.randint(1, 12))], lambda: [f"{d(2)}.{d(2)}"], lambda: [f"20{d(2)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}:{d(2)}"],
                lambda: [f"{d(1)}.{d(1)}.{d(2)}"], lambda: [f"{r.randint(256, 999)}.{d(2)}.{d(1)}.{d(3)}"], lambda: [next(x for x in iter(lambda: d(16), None) if not luhn(x))],
                lambda: [f"@{name(6)}"], lambda: [f"{name(3)}@{name(3)}"], lambda: [f"http://{name(6)}.{name(3)}/{name(4)}?page={d(1)}"], lambda: [name(6) + d(2)],
                lambda: [r.choice(("token", "key", "secret", "password"))], lambda: [name(5), "=", d(2)], lambda: ["|"], lambda: [f"({name(4)})"], lambda: [f"{d(1)}.{d(1)}"], lambda: [name(2).upper(), f"{d(1)}.{d(1)}"], lambda: [f"{d(r.randint(1, 6))}.{d(r.randint(1, 4))}"], lambda: [f"({d(r.randint(1, 4))})"], lambda: [f"{d(r.randint(1, 4))}-{d(r.randint(1, 4))}"], lambda: [f"v{d(1)}.{d(1)}.{d(1)}"], lambda: [d(r.randint(1, 3)), d(r.randint(1, 4))], lambda: [f"${d(3)}"], lambda: [name(r.randint(16, 40))], lambda: [f"{name(4)}.{name(7)}.com"],
            )
        )()

    def one(kind: str) -> tuple[list[str], list[str]]:
        if kind == "secret":
            return secret()
        if kind == "email":
            t = [f"{r.choice((name(5), name(4) + '.' + name(6), name(3) + d(2), d(2)))}@{name(r.randint(4, 8))}{r.choice(('', d(1)))}.{r.choice(('com', 'org', 'example.com', 'co.uk', 'net'))}"]
        elif kind == "ip":
            t = [".".join(str(r.randint(0, 255)) for _ in range(4))]
        else:
            t = card() if kind == "card" else phone()
        if r.random() < 0.3:
            t[-1] += r.choice((".", ",", "###", "$$$", "%%%", "***", "&&&"))
        return t, [f"B-{kind}", *[f"I-{kind}"] * (len(t) - 1)]

    rows = []
    for i in range(n):
        tokens, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                tokens.append(word())
                labels.append("O")
            x = r.random()
            if x < 0.45:
                t, l = one(r.choice(KINDS))
            elif x < 0.8:
                t = sums() if r.random() < 0.25 else noise()
                l = ["O"] * len(t)
            else:
                continue
            tokens += t
            labels += l
        if tokens:
            rows.append((i, tokens, labels))
    return rows


# ---- the random field


@dataclass
class Field:
    """Weights by feature for the token before, the token itself and the token after; transitions; start scores."""

    names: dict[str, int]
    weights: np.ndarray  # 3, features, labels
    trans: np.ndarray
    start: np.ndarray

    def rows(self, tokens: list[str]) -> np.ndarray:
        """For each token its scores as neighbour before, itself and neighbour after: tokens, 3, labels."""
        out = np.zeros((len(tokens), 3, self.trans.shape[0]), np.float32)
        for i, t in enumerate(tokens):
            ids = [j for f in features(t) if (j := self.names.get(f)) is not None]
            if ids:
                out[i] = self.weights[:, ids].sum(axis=1)
        return out


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """0 where a label may follow another or start a line, else a large negative number."""
    n = len(LABELS)
    step, start = np.zeros((n, n)), np.zeros(n)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            start[j] = -1e4
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:] or a == "O":
                    step[i, j] = -1e4
    return step, start


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(rows: list[tuple[int, list[str], list[str]]], steps: int = 60, l2: float = 0.02) -> Field:
    """Maximum likelihood by full-batch Adam with forward-backward over padded rows."""
    if len(rows) > MAX_ROWS:
        raise ValueError(f"the labelled table has more than {MAX_ROWS} rows")
    rows = [x for x in rows if x[1]]
    names: dict[str, int] = {}
    kinds: dict[tuple, int] = {}
    seqs = [[kinds.setdefault(tuple(sorted({names.setdefault(f, len(names)) for f in features(t)})), len(kinds)) for t in x[1]] for x in rows]
    n, long, L, K = len(rows), max(map(len, seqs)), len(LABELS), len(kinds)
    has = np.zeros((K, len(names)), np.float32)
    for k, i in kinds.items():
        has[i, list(k)] = 1
    tok, gold, mask = np.full((n, long), K), np.zeros((n, long), np.int64), np.zeros((n, long), bool)
    at = {x: i for i, x in enumerate(LABELS)}
    for i, (s, x) in enumerate(zip(seqs, rows, strict=True)):
        tok[i, : len(s)], gold[i, : len(s)], mask[i, : len(s)] = s, [at[y] for y in x[2]], True
    before, after = np.full_like(tok, K), np.full_like(tok, K)
    before[:, 1:], after[:, :-1] = tok[:, :-1], tok[:, 1:]
    near = (before, tok, after)
    hard, hard_start = allowed()
    w, trans, start = np.zeros((3, len(names), L)), np.zeros((L, L)), np.zeros(L)
    params = (w, trans, start)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    hot = np.eye(L)[gold] * mask[:, :, None]
    for step in range(1, steps + 1):
        table_ = np.concatenate([has @ w, np.zeros((3, 1, L))], axis=1)
        e = sum(table_[j][near[j]] for j in range(3))
        tr, st = trans + hard, start + hard_start
        alpha, beta = np.zeros((n, long, L)), np.zeros((n, long, L))
        alpha[:, 0] = st + e[:, 0]
        for t in range(1, long):
            a = _lse(alpha[:, t - 1, :, None] + tr, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        z = _lse(alpha[:, -1], 1)
        pair = np.zeros((L, L))
        for t in range(long - 1, 0, -1):
            nxt = e[:, t] + beta[:, t]
            live = mask[:, t, None]
            p = np.exp(np.minimum(alpha[:, t - 1, :, None] + tr + nxt[:, None, :] - z[:, None, None], 0)) * live[:, :, None]
            pair += p.sum(axis=0)
            beta[:, t - 1] = np.where(live, _lse(tr + nxt[:, None, :], 2), 0)
        post = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
        diff = hot - post
        gw = np.zeros_like(w)
        for j in range(3):
            sums = np.zeros((K + 1, L))
            np.add.at(sums, near[j].ravel(), diff.reshape(-1, L))
            gw[j] = has.T @ sums[:K]
        gt = np.zeros((L, L))
        np.add.at(gt, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        grads = (gw - l2 * w, gt - pair - l2 * trans, diff[:, 0].sum(axis=0) - l2 * start)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, w.astype(np.float32), (trans + hard).astype(np.float32), (start + hard_start).astype(np.float32))


PIECE = 128


def _lead(field: Field) -> float:
    """The most that a path can lose by transitions when a token's label becomes O, and an I- label after it the B- of its kind."""
    step, n = field.trans, len(LABELS)
    fresh = [j - 1 if LABELS[j][0] == "I" else j for j in range(n)]
    most = 0.0
    for before in [*step, field.start]:
        enter = before[1:] - before[0]
        for l in np.flatnonzero(before[1:] > -1e3).tolist():
            for b in range(n):
                if step[l + 1, b] > -1e3:
                    on = step[b] > -1e3
                    after = max(0.0, float((step[b][on] - step[fresh[b]][on]).max())) if fresh[b] != b else 0.0
                    most = max(most, float(enter[l]) + float(step[l + 1, b] - step[0, fresh[b]]) + after)
    return most


class Decoder:
    """Viterbi over many lines; keeps the scores of tokens it has met, by what their features add up to."""

    def __init__(self, field: Field):
        self.field = field
        self.at: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.scores = np.zeros((0, 3, len(LABELS)), np.float32)
        self.lead = _lead(field)

    def learn(self, tokens) -> None:
        new = []
        for t in tokens:
            f = features(t)
            k = self.kinds.get(f)
            if k is None:
                k = self.kinds[f] = len(self.kinds)
                new.append(t)
            self.at[t] = k
        if new:
            self.scores = np.concatenate([self.scores, self.field.rows(new)])

    def pieces(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of the pieces that lines are decoded in, and whether a line begins there.

        A long line is cut after tokens that are O on every best path: where O's lead is larger than all that
        transitions and a fresh start of the next token's label could make up for. e loses their other labels.
        """
        sizes = np.diff(starts)
        begin, size, first = [starts[:-1]], [sizes], [np.ones(len(sizes), bool)]
        for i in np.flatnonzero(sizes > 2 * PIECE).tolist():
            a, b = int(starts[i]), int(starts[i + 1])
            own = e[a:b]
            fresh = np.maximum((own[1:, 2::2] - own[1:, 1::2]).max(axis=1), 0)
            sure = np.flatnonzero(own[:-1, 0] - own[:-1, 1:].max(axis=1) > self.lead + fresh) + 1
            cuts, at = [], 0
            while (j := int(np.searchsorted(sure, at + PIECE))) < len(sure):
                at = int(sure[j])
                cuts.append(at)
            if cuts:
                own[np.array(cuts) - 1, 1:] = -1e6
                edges = np.array([0, *cuts, b - a])
                size[0][i] = edges[1]
                begin.append(a + edges[1:-1])
                size.append(np.diff(edges)[1:])
                first.append(np.zeros(len(cuts), bool))
        return np.concatenate(begin), np.concatenate(size), np.concatenate(first)

    def labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best label numbers of each line's tokens."""
        flat = [t for line in lines for t in line]
        new = set(flat).difference(self.at)
        if len(self.at) + len(new) > CACHE_WORDS or len(self.kinds) > CACHE_WORDS // 4:
            self.at, self.kinds, self.scores = {}, {}, self.scores[:0]
            new = set(flat)
        self.learn(new)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ids = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        e = self.scores[ids, 1]
        joined = np.ones(max(len(ids) - 1, 0), bool)  # a neighbour in the same line
        joined[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(ids))] - 1] = False
        if len(ids):
            e[1:] += self.scores[ids[:-1], 0] * joined[:, None]
            e[:-1] += self.scores[ids[1:], 2] * joined[:, None]
        begin, size, first = self.pieces(e, starts)
        order = np.argsort(-size, kind="stable")
        begin, size, first = begin[order], size[order], first[order]
        trans, L = self.field.trans, len(LABELS)
        alive = int((size > 0).sum())
        best = np.zeros(len(ids), np.int8)
        if not alive:
            return [best[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        back = np.zeros((len(ids), L), np.int8)
        longest = int(size[0])
        counts = np.searchsorted(-size, -np.arange(longest), side="left")  # lines longer than t
        score = np.where(first[:alive, None], self.field.start, trans[0]) + e[begin[:alive]]
        final = np.zeros((alive, L), np.float32)
        for t in range(1, longest):
            n = int(counts[t])
            final[n : len(score)] = score[n:]
            score = score[:n]
            step = score[:, :, None] + trans
            arg = step.argmax(axis=1)
            at = begin[:n] + t
            back[at] = arg
            score = np.take_along_axis(step, arg[:, None, :], axis=1)[:, 0] + e[at]
        final[: len(score)] = score
        now = final.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            n = int(counts[t])
            at = begin[:n] + t
            best[at] = now[:n]
            now[:n] = back[at, now[:n]]
        return [best[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


TOKEN = re.compile(r"\S+")
EDGE = "\"'.,;:!?()[]{}<>#$%&*|="
#: a name before a secret in the same token
LEAD = re.compile(r"[\"'({\[<]*[A-Za-z][\w.-]*[\"']?[=:](?=[^=])")


def field_spans(lines: list[str], labels: list[np.ndarray]) -> list[tuple[str, int, int]]:
    """Spans of a text's lines from their labels; signs around a token are left out."""
    out, offset = [], 0
    for line, found in zip(lines, labels, strict=True):
        if found.any():
            places = [m.span() for m in TOKEN.finditer(line)]
            i = 0
            while i < len(found):
                name = LABELS[found[i]]
                j = i + 1
                if name[0] == "B":
                    while j < len(found) and LABELS[found[j]] == "I-" + name[2:]:
                        j += 1
                    a, b = places[i][0], places[j - 1][1]
                    if name == "B-secret":  # the value after a key word
                        if lead := LEAD.match(line, a, b):
                            a = lead.end()
                    edge = EDGE.replace("(", "") if name == "B-phone" else EDGE
                    while a < b and line[a] in edge:
                        a += 1
                    tail = EDGE.replace("=", "") if name == "B-secret" else EDGE  # which may end in padding
                    while a < b and line[b - 1] in tail:
                        b -= 1
                    if a < b:
                        out.append((name[2:], offset + a, offset + b))
                i = j
        offset += len(line) + 1
    return out


def all_spans(base: list, added: list) -> list[tuple[str, int, int]]:
    """Base spans and those added ones that touch none, by kind as listed, then start."""
    if not added:
        return base
    kept = [x for x in added if not any(x[1] < b and a < x[2] for _, a, b in base)]
    return sorted(base + kept, key=lambda x: (KINDS.index(x[0]), x[1]))


@functools.lru_cache(maxsize=2)
def default_field() -> Field:
    return train(labelled_rows())


def fit(labelled: DataFrame) -> Field:
    """From a labelled table (id, tokens array<string>, labels array<string>) of at most MAX_ROWS rows."""
    rows = labelled.select("id", "tokens", "labels").limit(MAX_ROWS + 1).collect()
    return train([(r.id, list(r.tokens), list(r.labels)) for r in sorted(rows, key=lambda r: r.id) if r.tokens and r.labels])


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans (arrays of kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights of a small table's features
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def factory():
        decoder = Decoder(shared.value)

        def run(batch):
            texts = texts_of(batch)
            lines = [t.split("\n") for t in texts]
            labels = decoder.labels([x.split() for ls in lines for x in ls])
            base, spans, at = [], [], 0
            for t, ls in zip(texts, lines, strict=True):
                own = base_spans(t)
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                found = all_spans(own, field_spans(ls, labels[at : at + len(ls)]))
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in found])
                at += len(ls)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

        return run

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], factory, f"doc_id long, base {kind}, spans {kind}", rows=128)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    labelled = spark.createDataFrame(labelled_rows(), "id int, tokens array<string>, labels array<string>")
    found = find_pii(table(spark, sf_dir, "documents"), fit(labelled))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
