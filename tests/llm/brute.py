"""Plain, slow versions of the operators' results, written from their contracts."""

import hashlib
import math
import re
from collections import Counter

from lodestone.llm import secrets as secrets_module

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = set()
    for i, w in enumerate(windows):
        if w in often:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(1 for x in spans if x[1] == k) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def dedup_lines(docs, min_words=50):
    """{key: line numbers to delete}: runs of at least min_words words that any earlier place has as well, by comparing every pair of equal lines.

    docs: {key: text}, with keys in the order of documents. A line counts for min_words words at most.
    """
    rows = [(k, i, x.strip(" \t\r"), min(min_words, len(WORD.findall(x)))) for k in sorted(docs) if docs[k] is not None for i, x in enumerate(docs[k].split("\n")) if WORD.search(x)]
    places, gone = {}, {}
    for a, (_, _, line, _) in enumerate(rows):
        for b in places.setdefault(line, []):
            n = size = 0
            while a + n < len(rows) and rows[a + n][2] == rows[b + n][2] and rows[a + n][0] == rows[a][0] and rows[b + n][0] == rows[b][0]:
                size += rows[a + n][3]
                n += 1
            if size >= min_words:
                gone.setdefault(rows[a][0], set()).update(r[1] for r in rows[a : a + n])
        places[line].append(a)
    return gone


def _upper(z):
    return math.erfc(z / math.sqrt(2)) / 2


def randomness(token):
    """Three times the least of the p-values of chi-squared, runs and serial correlation, one at most; None where no encoding fits."""
    body = re.sub("=+$", "", token.replace("_", "/").replace("-", "+"))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    for form, alphabet in (
        ("[0-9]+", digits), ("[0-9a-f]+|[0-9A-F]+", digits + "ABCDEF"), ("[A-Z2-7]+=*", upper + "234567"), ("[0-9a-z]+|[0-9A-Z]+", digits + upper), ("[A-Za-z0-9+/_-]+=*", upper + lower + digits + "+/"),
    ):
        if re.fullmatch(form, token):
            break
    else:
        return None
    x = [alphabet.index(c) for c in (body if lower[0] in alphabet else body.upper())]
    n, k = len(x), len(alphabet)
    chi = k / n * sum(c * c for c in Counter(x).values()) - n
    spread = 2 / (9 * (k - 1))
    ps = [_upper(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))]
    high = [2 * s >= k for s in x]
    h = sum(high)
    if h in (0, n):
        ps.append(0.0)
    else:
        mean = 2 * h * (n - h) / n + 1
        ps.append(2 * _upper(abs(1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))))
    mean = sum(x) / n
    var = sum((s - mean) ** 2 for s in x)
    ps.append(2 * _upper(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n)) if var else 0.0)
    return min(1.0, 3 * min(ps))


def ordinariness(token):
    """One over the likelihood ratio of even draws to ordinary text: changes of kind at a rate of 0.02 or 0.05, and letters by three parts."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    differ = lambda a, b: kind(a) != kind(b) and 3 not in (kind(a), kind(b))
    abc = next((abc for _, form, abc in secrets_module.ENCODINGS if re.search(form, token)), None)
    changes = sum(map(differ, token, token[1:]))
    if not changes or abc is None:
        return 1.0
    q = 0.02 if not any(c.islower() for c in abc) else 0.05
    u = min(max(sum(differ(a, b) for a in abc for b in abc) / len(abc) ** 2, 0.001), 0.999)
    out = changes * math.log(u / q) + (len(token) - 1 - changes) * math.log((1 - u) / (1 - q))
    letters = [c.lower() for c in abc if c.isalpha()]
    for part, share in (("etaoinsr", 0.64), ("dlcumhgbpf", 0.28), ("jkqvwxyz", 0.08)):
        out += sum(c.lower() in part for c in token) * math.log(max(sum(c in part for c in letters) / max(len(letters), 1), 0.001) / share)
    return math.exp(-max(out, 0))


def step_of(p):
    return min(600, math.floor(-math.log10(max(p, 1e-30)) * 20))


def threshold(steps, share=0.01):
    """Benjamini and Hochberg over p-values of 10 ** (-step / 20): the least step that is rejected."""
    passed = [s for s in set(steps) if len(steps) * 10 ** (-s / 20) <= share * sum(x >= s for x in steps)]
    return min(passed, default=601)


def random_spans(texts):
    """Per text the spans (start, end) of the battery, over all texts together."""
    found = []
    for i, t in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in secrets(t)[2].split(",") if s]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t or ""):
            if all(e <= m.start() or m.end() <= s for s, e in base) and (p := randomness(m[0])) is not None:
                found.append((i, m.span(), step_of(p), step_of(ordinariness(m[0]))))
    refused, least = threshold([f[2] for f in found]), threshold([f[3] for f in found])
    out = [[] for _ in texts]
    for i, span, fit, step in found:
        if fit < refused and step >= least:
            out[i].append(span)
    return out
