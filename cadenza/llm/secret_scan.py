"""Secret scans: an Aho-Corasick pass finds keywords, expressions anchored at the hits bound the secrets,
and embedded checksums decide where a token format has one.

Base kinds, each leftmost and non-overlapping: ``assign`` (a named value of 12 characters or more), ``access``
(``AKIA`` keys of 18 or more) and ``hex`` (runs of 16 or more lower-case hex digits, which have no keyword and are
found by their own character class). Added kinds: ``github`` and ``npm`` tokens, kept only if the CRC-32 in their last
six base-62 digits holds, and ``jwt``, kept only if the header decodes to a JSON object with an ``alg`` (one that is
nested deeper than Python's parser goes is none). Time is linear in a text's length.

Null text counts as empty; an empty text has no spans. Every row gives one row, repeated rows and null ids too.
Other columns of the input are ignored. The work is one narrow map, so memory is that of one Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"

# The expressions of the base kinds and the public token formats.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
JWT_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``, as the token formats embed it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _jwt_ok(head: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


def jwts(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping tokens from the sorted hits of their first three letters.

    A token's first part ends where the run of its characters does, so whether the rest follows is the same for every hit
    within a run: each run is looked at once, however many hits it has.
    """
    free, run, rest = 0, -1, None
    for start in starts:
        if start < free or text[start : start + 3] != "eyJ":
            continue
        if start >= run:
            run = JWT_RUN.match(text, start).end()
            rest = JWT_REST.match(text, run)
        if rest and run > start + 3:
            free = rest.end()
            if _jwt_ok(text[start:run]):
                yield start, free


#: Each kind's expression and what else must hold of a match.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 18),
    "github": (GITHUB, lambda m: base62_crc(m[1]) == m[2]),
    "npm": (NPM, lambda m: base62_crc(m[1]) == m[2]),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(text: str, words) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then kind as listed; ``words`` is :func:`automaton`'s."""
    # Only ASCII letters are folded, so that places in the folded text are places in the text.
    folded = text.lower() if text.isascii() else text.encode().lower().decode()
    hits: dict[str, list[int]] = {}
    for last, (length, kind) in words.iter(folded):
        hits.setdefault(kind, []).append(last + 1 - length)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    spans += [(a, b, "jwt") for a, b in jwts(text, sorted(hits.pop("jwt", ())))]
    for kind, starts in hits.items():
        rule, holds = RULES[kind]
        free = 0
        for start in sorted(starts):
            if start >= free and (m := rule.match(text, start)):
                free = m.end()
                if holds(m):
                    spans.append((start, free, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    empty = hashlib.sha256(b"").hexdigest()
    for batch in sliced(batches):
        count = {k: [] for k in (*BASE, "more")}
        digest, joined = [], []
        for text in batch.column(1).to_pylist():
            spans = find(text, words) if text else []
            base = [s for s in spans if s[2] in BASE]
            for k in BASE:
                count[k].append(sum(s[2] == k for s in base))
            count["more"].append(len(spans) - len(base))
            digest.append(hashlib.sha256(told(base).encode()).hexdigest() if base else empty)
            joined.append(told(spans))
        longs = [pa.array(count[k], pa.int64()) for k in (*BASE, "more")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *longs[:3], pa.array(digest, pa.string()), pa.array(joined, pa.string()), longs[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan, SCHEMA)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every span, overlapping ones merged, replaced by ``mark``; ``n_chars`` follows."""
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in sliced(batches):
            texts, changed = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                if text and (spans := find(text, words)):
                    parts, last = [], 0
                    for a, b, _ in spans:
                        if a >= last:
                            parts += [text[last:a], mark]
                        last = max(last, b)
                    changed[i] = texts[i] = "".join([*parts, text[last:]])
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if chars is not None:
                    now = columns[chars].to_pylist()
                    for i, text in changed.items():
                        now[i] = len(text)
                    columns[chars] = pa.array(now, batch.schema.field(chars).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
