"""Secret scans by a character convolutional network over candidates and their context.

Candidates overlap, and each is judged for itself:
- values assigned to a name by = : := => == and the like, blanks around them or not, of 6 characters or more. A quoted
  value runs to its closing quote on the line. An unquoted one runs to a blank, quote or angle bracket; it is taken up
  to its first comma or semicolon and also beyond it, up to the next name= or name: after & , or ;, and without symbols at
  its end if 6 characters are left. One of more than LONG characters ends at the next sign, so that long lists of
  assignments cost no square. Names in URLs and after other values count like any other;
- what stands between user: and @host, with a scheme or without, and what follows Bearer, Basic or Token;
- runs of 16 or more characters of the base64 alphabet, _ - and . that hold a digit (or 8 capitals, two of them side
  by side), and private key blocks.
Not candidates: values under 6 characters, values that no sign assigns (password hunter22, XML elements), quoted values
over several lines, and unquoted ones after a line break.

The network reads BEFORE characters, the whole candidate and AFTER characters: WIDTH characters at a time
go through FILTERS filters, whose greatest value in each of the three parts and mean in the candidate go through
HIDDEN units to one logit. It is written and trained in numpy, on the labelled findings of findings().

A held-out part of the findings calibrates it: a temperature makes the probabilities honest, and each kind of
candidate gets the greatest threshold that finds at least RECALL of its secrets, but 0.5 at most.

Null and empty texts hold no candidates. Overlapping candidates are one finding, of the longest secret span. Rows
without a doc_id are left out by scan(), and redacted like any other by redact(). Repeated rows are scanned each.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

BEFORE, AFTER, WIDTH, FILTERS, HIDDEN, RECALL, FINDINGS, LONG = 32, 12, 5, 40, 32, 0.995, 16000, 512
KINDS = ("assigned", "opaque", "block")
_SIGN = re.compile(r"[?+!]?(?::+=?|=+>?)")
_QUOTE = re.compile(r"""[ \t]*(?:\\?\r?\n[ \t]*)?(\\*["'`])""")
_BARE = re.compile(r"""[^\s"'`<>]+""")
_NEXT = re.compile(r"[&,;](?:amp;)?[A-Za-z_][A-Za-z0-9_.\-\[\]]*[=:]")
_SCHEME = re.compile(r"(?i)(?:Bearer|Basic|Token)[ \t]+(?=\S)")
_USERINFO = re.compile(r"""://[^\s/@:"'`<>]*:([^\s"'`<>/]{6,})@""")
_AUTHORITY = re.compile(r"""//[^\s/@:"'`<>]*:\Z""")
_HOST = re.compile(r"[A-Za-z0-9\[]")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_.\-]{16,}={0,2}")
_CAPITALS = re.compile("[A-Z][A-Z]")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----)?")
#: What every text with a candidate has: this much the JVM looks for before Python sees a text.
POSSIBLE = "[0-9=:]|[A-Z][A-Z]"
SYMBOLS = 98
_CODE = np.array([97 if b >= 128 else 1 if b in (9, 10, 13) else b - 30 if 32 <= b < 127 else 1 for b in range(256)], np.int64)


def _named(text: str, at: int) -> bool:
    """Whether a name ends at that place, blanks, quotes and brackets aside."""
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"'`\\])}":
        at -= 1
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
        at -= 1
        if text[at].isalpha() or text[at] == "_":
            return True
    return False


def _closing(text: str, at: int, quote: str) -> int:
    """Where the value that begins there ends with that quote on its line; -1 if it doesn't."""
    k = text.find(quote, at)
    while k >= 0 and "\n" not in text[at:k]:
        back = k
        while len(quote) == 1 and back > at and text[back - 1] == "\\":
            back -= 1
        if (k - back) % 2 == 0:
            return k
        k = text.find(quote, k + 1)
    return -1


def _values(text: str, at: int, colon: bool) -> Iterator[tuple[int, int]]:
    """Spans of what may be the value after the sign that ends there."""
    if m := _QUOTE.match(text, at):
        quote, a = m[1], m.end()
        if len(quote) == 1 and text.startswith(2 * quote, a):  # three of them
            quote, a = 3 * quote, a + 2
        if (b := _closing(text, a, quote)) >= 0:
            yield a, b
            if s := _SCHEME.match(text, a, b):
                yield s.end(), b
            return
        start = a
    else:
        start = at
        while text[start : start + 1] in (" ", "\t"):
            start += 1
    if colon and text.startswith("//", start):  # the scheme of a URL, whose parts are candidates
        return
    if s := _SCHEME.match(text, start):
        start = s.end()
    if not (m := _BARE.match(text, start, start + LONG + 1)):
        return
    a, b = m.span()
    if b - a > LONG and not (n := _SIGN.search(text, a, b)):
        b = _BARE.match(text, start).end()
        n = _SIGN.search(text, a, b)
    elif b - a <= LONG:
        n = _NEXT.search(text, a, b)
    if n:
        b = n.start()
    host = text.rfind("@", a, b)
    if colon and start == at and host > a and _HOST.match(text, host + 1):  # user:password@host
        yield a, host
        if _AUTHORITY.search(text, max(0, at - 80), at):
            return
    first = next((k for k in range(a, b) if text[k] in ",;"), b)
    for end in {first, b}:
        least = end
        while least > a and text[least - 1] in ".!*%$#&),;":
            least -= 1
        if end - a >= 6:
            yield a, least if least - a >= 6 else end


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every candidate, by start."""
    found = {}
    for m in _OPAQUE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-":
            b -= 1
        run = text[a:b]
        if b - a >= 16 and (any(c.isdigit() for c in run) or sum(c.isupper() for c in run) >= 8 and _CAPITALS.search(run)):
            found[a, b] = 1
    for m in _SIGN.finditer(text):
        if _named(text, m.start()):
            for a, b in _values(text, m.end(), m[0] == ":"):
                if b - a >= 6:
                    found[a, b] = 0
    for m in _USERINFO.finditer(text):
        found[m.span(1)] = 0
    for m in _BLOCK.finditer(text):
        found[m.span()] = 2
    return sorted((k, a, b) for (a, b), k in found.items())


def _encode(text: str, a: int, b: int) -> np.ndarray:
    """Symbols of context, candidate, context; each non-ASCII character is one."""
    raw = np.array([_CODE[min(ord(c), 255)] for c in text[max(0, a - BEFORE) : b + AFTER]], np.int64)
    return np.concatenate([np.zeros(BEFORE - min(a, BEFORE), np.int64), raw, np.zeros(max(0, AFTER - (len(text) - b)), np.int64)])


def _batch(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded symbols (rows, length + WIDTH - 1) and the length of each row's candidate."""
    sizes = np.array([len(r) - BEFORE - AFTER for r in rows])
    x = np.zeros((len(rows), sizes.max() + BEFORE + AFTER + WIDTH - 1), np.int64)
    for k, r in enumerate(rows):
        x[k, WIDTH // 2 : WIDTH // 2 + len(r)] = r
    return x, sizes


class Net:
    """Symbols -> convolution -> ReLU -> maxima of three parts and mean of the candidate -> ReLU -> logit."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.RandomState(seed)
        self.p = {"w": r.randn(WIDTH, SYMBOLS, FILTERS) * 0.15, "c": np.zeros(FILTERS), "u": r.randn(4 * FILTERS, HIDDEN) * (0.5 / FILTERS) ** 0.5, "d": np.zeros(HIDDEN), "v": r.randn(HIDDEN) * HIDDEN**-0.5, "e": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        length = x.shape[1] - WIDTH + 1
        z = sum(self.p["w"][k][x[:, k : k + length]] for k in range(WIDTH)) + self.p["c"]
        a = np.maximum(z, 0)
        at = np.arange(length)
        parts = [at < BEFORE, (at >= BEFORE) & (at < BEFORE + sizes[:, None]), (at >= BEFORE + sizes[:, None]) & (at < BEFORE + sizes[:, None] + AFTER)]
        parts[0] = np.broadcast_to(parts[0], parts[1].shape)
        tops = [np.where(m[:, :, None], a, -1).argmax(1) for m in parts]
        maxima = [np.take_along_axis(a, t[:, None], 1)[:, 0] for t in tops]
        mean = (a * parts[1][:, :, None]).sum(1) / sizes[:, None]
        pooled = np.concatenate([*maxima, mean], 1)
        h = np.maximum(pooled @ self.p["u"] + self.p["d"], 0)
        return h @ self.p["v"] + self.p["e"][0], a, parts, tops, pooled, h

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, a, parts, tops, pooled, h = self.forward(x, sizes)
        g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        out = {"v": h.T @ g, "e": g.sum(keepdims=True)}
        gh = np.outer(g, self.p["v"]) * (h > 0)
        out |= {"u": pooled.T @ gh, "d": gh.sum(0)}
        gp = gh @ self.p["u"].T
        gz = (parts[1] / sizes[:, None])[:, :, None] * gp[:, None, 3 * FILTERS :]
        for k, t in enumerate(tops):
            np.put_along_axis(gz, t[:, None], np.take_along_axis(gz, t[:, None], 1) + gp[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
        gz = (gz * (a > 0)).astype(np.float32).reshape(-1, FILTERS)
        out |= {"c": gz.sum(0), "w": np.zeros_like(self.p["w"])}
        length = a.shape[1]
        for k in range(WIDTH):
            hot = np.zeros((len(gz), SYMBOLS), np.float32)
            hot[np.arange(len(gz)), x[:, k : k + length].ravel()] = 1
            out["w"][k] = hot.T @ gz
        return out

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of encoded candidates; those of like lengths together."""
        out, order, k = np.zeros(len(rows)), sorted(range(len(rows)), key=lambda i: len(rows[i])), 0
        while k < len(order):
            n = max(1, min(256, 40_000 // len(rows[order[min(len(order), k + 256) - 1]])))
            out[order[k : k + n]] = self.forward(*_batch([rows[i] for i in order[k : k + n]]))[0]
            k += n
        return out


@dataclass
class Model:
    net: Net
    temperature: float
    thresholds: tuple[float, ...]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.net.logits(rows) / self.temperature)) if rows else np.zeros(0)


def findings(n: int = FINDINGS, seed: int = 23) -> list[tuple[str, int, int, int, int]]:
    """Labelled findings (text, kind, start, end, secret 0/1): the candidates at what planted() plants. A candidate of which a secret is less than half is left out; one that runs on to the @host is none; an opaque part of an assigned secret, which is judged whole, is left out too."""
    out: list[tuple[str, int, int, int, int]] = []
    for text, start, end, label in planted(seed):
        every = candidates(text)
        for k, a, b in every:
            if label and k == 1 and any(j == 0 and u <= a and b <= v for j, u, v in every):
                continue
            shared = min(b, end) - max(a, start)
            if shared > 0 and (not label or 2 * shared >= b - a):
                out.append((text, k, a, b, int(label and not (b > end and text[end] == "@"))))
        if len(out) >= n:
            return out[:n]
    return out


def planted(seed: int) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, secret 0/1) without end: texts made of public key formats, passwords and look-alikes, and where they stand, whether a candidate or not."""
    r = np.random.RandomState(seed)
    pick = lambda xs: xs[r.randint(len(xs))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.randint(0, len(alphabet), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum, b64 = low + up + dig, low + up + dig + "+/"
    hexa = lambda k: chars("0123456789abcdef", k)
    syllables = "an er on re en de la ie ch tion ung ment ado ou le es that ver eau os ing und".split()
    word = lambda: "".join(pick(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() + pick(["", "", "", ",", ".", ".\n"]) for _ in range(k))
    names = ["token", "token", "token", "token", "secret", "secret", "secret", "password", "password", "password", "api_key", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "secret_key", "client_secret", "auth_token", "access_token", "private_key", "DB_PASSWORD", "SECRET_KEY", "aws_secret_access_key", "credential", "passphrase", "bearer_token", "Authorization", "key"]
    plain = ["sha256", "md5", "checksum", "etag", "commit", "digest", "hash", "id", "uuid", "version", "url", "path", "image", "color", "width", "phone", "order", "date", "isbn", "file", "name", "title", "ref", "build", "size", "author", "email", "time", "location"]
    passwords = ["password", "passwd", "pwd", "passphrase", "DB_PASSWORD", "Password"]
    between = ["=", " = ", ": ", ":", " := ", " => "]
    noise = ["", "", "", "", "***", "!!", "%%%", "$$$", "###", "&&&", ".", ","]

    def opaque() -> str:
        return pick([lambda: hexa(pick([32, 40, 40, 48, 64])), lambda: chars(alnum, r.randint(16, 48)), lambda: chars(b64, r.randint(20, 60)) + pick(["", "=", "=="]), lambda: chars(low + dig, r.randint(16, 40)), lambda: chars(up + dig, r.randint(16, 40)), lambda: hexa(40).upper()])()

    def vendor() -> str:
        return pick([lambda: pick(["AKIA", "AKIA", "ASIA"]) + chars(up + dig, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + chars(alnum, 36), lambda: f"xox{pick('bpas')}-{chars(dig, 11)}-{chars(dig, 12)}-{chars(alnum, 24)}", lambda: pick(["sk_live_", "rk_live_", "sk-"]) + chars(alnum, pick([24, 32, 48])), lambda: "AIza" + chars(alnum + "_-", 35), lambda: "eyJhbGciOi" + chars(alnum, 20) + "." + chars(alnum + "_-", 60) + "." + chars(alnum + "_-", 43), lambda: "glpat-" + chars(alnum, 20), lambda: "npm_" + chars(alnum, 36)])()

    def password() -> str:
        return chars(alnum + "!@#%^&*_-", r.randint(6, 20)) if r.rand() < 0.5 else pick([word() + chars(dig, r.randint(2, 6)), word().title() + chars("!@#_", 1) + chars(dig, 3) + word(), hexa(r.randint(6, 24)), chars(alnum, r.randint(6, 16))])

    def harmless() -> str:
        return pick([lambda: chars(dig, 16), lambda: chars(dig, 16), lambda: word().upper() + word().upper() + word().upper() + word().upper(), lambda: chars(dig, r.randint(16, 24)), lambda: f"{chars(dig, 4)}-{chars(dig, 4)}-{chars(dig, 4)}-{chars(dig, 4)}", lambda: f"20{chars(dig, 2)}-0{chars('123456789', 1)}-1{chars(dig, 1)}T1{chars(dig, 1)}.30.00", lambda: f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-a{hexa(3)}-{hexa(12)}", lambda: f"/{word()}/{word()}/{word()}{chars(dig, 2)}.html", lambda: f"{word()}_{word()}_{word()}_{chars(dig, 2)}", lambda: f"www.{word()}{word()}{chars(dig, 1)}.example.com", lambda: f"{word()}-{word()}-{word()}-{word()}-{chars(dig, 3)}", lambda: f"{word()}{word()}{word()}{chars(dig, 1)}", lambda: f"https://www.{word()}.example.com/{word()}/20{chars(dig, 2)}/0{chars(dig, 1)}/{word()}-{word()}-{word()}", lambda: f"{word()}.{chars(dig, 2)}@{word()}{chars(dig, 1)}.example.org"])()

    def value() -> str:
        return pick([lambda: word() + word(), lambda: word() + word() + ",", lambda: "********", lambda: "xxxxxxxx", lambda: "${" + word().upper() + "}", lambda: "YOUR_API_KEY", lambda: "required", lambda: "undefined", lambda: "os.environ", lambda: "getenv(" + word() + ")", lambda: f"{word()}_{word()}({word()})", lambda: f"{word()}.{word()}()", lambda: f"self.{word()}{word()}", lambda: f"${{{word().upper()}_{word().upper()}}}", lambda: f"{pick(['return', 'None', 'null', 'string', 'input'])} {word()}", lambda: "optional"])()

    while True:
        quote, before, after = pick(["", "", '"', '"', "'"]), prose(r.randint(0, 9)), prose(r.randint(0, 5))
        case, tail = r.rand(), pick(noise)
        kind, ahead, behind = r.randint(0, 16), "", ""
        if kind < 2:
            name, body, label = pick(names), opaque(), 1
        elif kind == 2:
            name, body, label = pick(passwords), password(), 1
        elif kind == 3:
            name, body, label = (pick(names) if r.rand() < 0.3 else None), vendor(), 1
        elif kind == 4 and r.rand() < 0.3:
            name, body, label = None, f"-----BEGIN {pick(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----\n" + "\n".join(chars(b64, 64) for _ in range(r.randint(1, 5))) + "\n-----END RSA PRIVATE KEY-----", 1
        elif kind == 5:
            name, body, label = None, harmless(), 0
        elif kind == 6:
            name, body, label = pick(plain), pick([opaque, harmless, lambda: hexa(pick([40, 64]))])(), 0
        elif kind == 7:
            name, body, label = pick(names), value(), 0
        elif kind == 8:
            name, body, label = pick(plain), pick([lambda: word() + word(), lambda: chars(dig, r.randint(6, 12)), lambda: f"https://{word()}.example.com/{word()}", lambda: f"{word()}@{word()}.example.com"])(), 0
        elif kind == 9:
            name, body, label = word(), pick([lambda: word() + word(), harmless])(), 0
        elif kind == 11:
            quote, name, label = pick(['"', "'", "`"]), pick(passwords), 1
            body = pick([lambda: chars(alnum, r.randint(3, 9)) + chars("!.*%$#&)", r.randint(1, 4)), lambda: chars(alnum, r.randint(1, 5)) + pick([",", ";", ",", "<", ">"]) + chars(alnum, r.randint(5, 10)), password])()
            body += chars(dig, max(0, 6 - len(body)))
        elif kind == 12:
            quote, name, body, label = pick(['"', "'"]), pick(passwords), " ".join(word() + word() for _ in range(r.randint(3, 6))), 1
        elif kind == 13:
            secret = r.rand() < 0.6
            quote, name, body, label = "", *((pick(passwords + names), pick([password, opaque])(), 1) if secret else (pick(plain), pick([lambda: word() + word(), harmless, lambda: chars(dig, r.randint(6, 12))])(), 0))
            body = re.sub("[&#]", "x", body)
            ahead, behind, tail = f"https://{word()}.example.com/{word()}?" + pick(["", f"{pick(plain)}={word()}&", f"user={word()}&"]), pick(["", f"&{pick(plain)}={word()}"]), ""
        elif kind == 14:
            quote, name, body, label = "", None, re.sub("[@/]", "x", password()), 1
            ahead, behind = pick(["postgres://", "mysql://", "https://", "redis://", "amqp://", "mongodb://", "ftp://", "-u "]) + pick([word(), word() + word(), "root", "admin", "app"]) + ":", "@" + pick(["db", "localhost", word() + ".example.com"]) + pick(["", ":5432/" + word(), "/" + word()])
        elif kind == 15 and r.rand() < 0.4:
            quote, name, body, label = "", pick(["Authorization", "authorization", "Proxy-Authorization", "auth"]), pick([opaque, vendor, lambda: chars(alnum, r.randint(8, 16))])(), 1
            behind, ahead = "", ""
            name += pick([": ", "=", ": "]) + pick(["Bearer ", "Basic ", "Token "])
        elif kind == 15:
            quote, name = pick(['"', '"', "'"]), pick(plain + [word()] * len(plain))
            body, label = prose(r.randint(2, 12)).replace("\n", ""), 0
            if r.rand() < 0.3:
                quote, name = "", None
                ahead, body = pick([("mailto:", f"{word()}.{word()}{word()}@{word()}.example.com"), (f"https://{word()}.example.com:", chars(dig, 4) + "/" + word() + word()), (f"http://{word()}:", chars(dig, 5) + "/" + word())])
        else:
            name, body, label = None, pick(plain) + " " + hexa(pick([40, 64])) if r.rand() < 0.4 else harmless(), 0
        lead = ahead + ("" if name is None else name if name[-1] == " " else name + ("=" if ahead else pick(between + ["   =   "]) if not quote else pick(["=", " = ", ": ", "    =  "])))
        text = f"{before} {lead}{quote}{body}{quote}{behind}{tail} {after}"
        if case < 0.12 and "BEGIN" not in body and not (label and name is None):
            text = text.upper()
        at = len(before) + 1 + len(lead) + len(quote)
        yield text, at, at + len(body), label


def train(labelled: list[tuple[str, int, int, int, int]], epochs: int = 10, seed: int = 11) -> Model:
    """Adam over batches of 64; every fourth finding, from the first on, is held out for calibration."""
    rows, y, kinds = [_encode(t, a, b) for t, _, a, b, _ in labelled], np.array([x[4] for x in labelled], np.float32), np.array([x[1] for x in labelled])
    held = np.arange(len(rows)) % 4 == 0
    fit = np.flatnonzero(~held)
    net, r = Net(seed), np.random.RandomState(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(fit)
        order = order[np.argsort([len(rows[i]) // 24 for i in order], kind="stable")]
        for part in r.permutation(np.array(np.array_split(order, max(1, len(order) // 64)), dtype=object)):
            part = part.astype(int)
            step += 1
            for k, g in net.gradients(*_batch([rows[i] for i in part]), y[part]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - 0.004 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    at = np.flatnonzero(held)
    logits = net.logits([rows[i] for i in at])
    loss = lambda t: np.logaddexp(0, np.where(y[at] > 0, -logits, logits) / t).mean()
    temperature = float(min(np.geomspace(0.2, 10, 60), key=loss))
    p = 1 / (1 + np.exp(-logits / temperature))
    thresholds = []
    for k in range(len(KINDS)):
        good = p[(kinds[at] == k) & (y[at] > 0)]
        thresholds.append(min(0.5, float(np.quantile(good, 1 - RECALL, method="lower"))) if len(good) else 0.5)
    return Model(net, temperature, tuple(thresholds))


@functools.cache
def fit() -> Model:
    """Trained on findings(), which depend on nothing: once in a process."""
    return train(findings())


def _found(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
    """Of each text: (start, end, kind, probability) of its secrets, overlapping ones merged, by start."""
    where, rows = [], []
    for i, t in enumerate(texts):
        for k, a, b in candidates(t) if t else ():
            where.append((i, k, a, b))
            rows.append(_encode(t, a, b))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for (i, k, a, b), p in sorted(zip(where, model.probabilities(rows).tolist()), key=lambda x: (x[0][0], x[0][2], -x[0][3])):
        if p >= model.thresholds[k]:
            if out[i] and a < out[i][-1][1]:
                s, e, k0, p0 = out[i][-1]
                out[i][-1] = (s, max(e, b), k0 if e - s >= b - a else k, max(p0, p))
            else:
                out[i].append((a, b, k, p))
    return out


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (characters), kind, probability, digest (SHA-256 of the secret) of every finding."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, out = batch.column(1).to_pylist(), batch.column(0).to_pylist(), []
            for i, t, found in zip(ids, texts, _found(model, texts)):
                out += [(i, a, b, KINDS[k], round(p, 6), hashlib.sha256(t[a:b].encode()).hexdigest()) for a, b, k, p in found]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()))], names=["doc_id", "start", "end", "kind", "probability", "digest"])

    return documents(docs).where(F.col("text").rlike(POSSIBLE)).mapInArrow(each, "doc_id BIGINT, start INT, end INT, kind STRING, probability DOUBLE, digest STRING")


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark, all rows and columns kept; n_chars, if there is one, follows the text."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, _found(model, list(texts))):
            for a, b, _, _ in reversed(found):
                t = t[:a] + mark + t[b:]
            out.append(t if found else None)
        return pd.Series(out, dtype=object)

    text = F.col("text")
    # Texts that can hold no candidate reach Python as null.
    new = docs.withColumn("text", F.coalesce(without(F.when(text.rlike(POSSIBLE), text)), text))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return new
