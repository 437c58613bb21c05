"""Secret scans by a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams that any match must
contain. Of every piece of a batch, postings are made for the trigrams that some rule asks for
(ASCII letters in lower case); the queries combine postings into candidate texts, and only those are
verified with the expression itself. A rule without mandatory trigrams scans all texts.

Defined results: null and empty texts have no secrets; secrets at any place are found, as texts
are scanned whole; matches of one rule don't overlap, those of several may; the scan reports what RULES match, of a key
its BEGIN line and of tokens what their bounds allow, while redaction takes WHOLE ones, a private key
without an END up to the end of the text; repeated rows are
each reported; rows with a null id are reported under null, ids may have any type; an empty table gives
no rows; other columns are ignored by the scan and kept by redaction, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.naming import fresh
from tidewater.llm.textscan import Joined, as_column, give_back, pieces

RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "github_fine_grained": r"\bgithub_pat_[0-9A-Za-z_]{22,255}",
    "gitlab_token": r"\bglpat-[0-9A-Za-z_-]{20}",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,250}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{24,99}",
    "model_api_key": r"\bsk-[0-9A-Za-z_-]{32,200}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,500}\.eyJ[0-9A-Za-z_-]{8,900}\.[0-9A-Za-z_-]{8,500}",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{1,15}://[0-9A-Za-z._~%-]{1,64}:[0-9A-Za-z._~%!$&*+=-]{3,64}@",
    "assigned_secret": r"""(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)["']?[ \t]{0,3}(?::=|=>|:|=)[ \t]{0,3}["'][0-9a-z/+_.=-]{16,200}["']""",
    "bare_hex_key": r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40})\b",
}

#: What redaction removes: the same rules, with secrets in whole. The SQL of the scan reports what RULES match.
WHOLE: dict[str, str] = RULES | {
    "github_fine_grained": r"\bgithub_pat_[0-9A-Za-z_]{22,}",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{24,}",
    "model_api_key": r"\bsk-[0-9A-Za-z_-]{32,}",
    # to its END, or to the end of the text, but not into another key
    "private_key": r"-----BEGIN (?:[0-9A-Z]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:(?!-----(?:BEGIN|END) )[\s\S])*+(?:-----END (?:[0-9A-Z]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)?",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{1,15}://[0-9A-Za-z._~%-]*+:[0-9A-Za-z._~%!$&*+=-]{3,}+@",
    "assigned_secret": RULES["assigned_secret"].replace("{16,200}", "{16,}+"),
}

SET_LIMIT = 64
ANY: tuple = ("any",)


def both(a: tuple, b: tuple) -> tuple:
    return b if a == ANY else a if b == ANY else ("and", a, b)


def either(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[bytes]) -> tuple:
    """The query that one of these strings occurs."""
    if any(len(s) < 3 for s in strings):
        return ANY
    each = []
    for s in sorted(strings):
        query = ANY
        for i in range(len(s) - 2):
            query = both(query, ("has", s[i : i + 3]))
        each.append(query)
    return either(each)


def _fold(char: int) -> bytes:
    text = chr(char)
    return (text.lower() if text.isascii() else text).encode("utf-8")


def _analyse(nodes) -> tuple[set[bytes] | None, tuple]:
    """(exactly the strings matched, or None if too many, query that any match satisfies)."""
    run: set[bytes] | None = {b""}
    whole, query = True, ANY

    def add(strings: set[bytes] | None, asked: tuple) -> None:
        nonlocal run, whole, query
        if strings is not None and len(run) * len(strings) <= SET_LIMIT:
            run = {a + b for a in run for b in strings}
            return
        query = both(query, _of_strings(run))
        whole, run = False, {b""}
        if strings is not None and len(strings) <= SET_LIMIT:
            run = set(strings)
        else:
            query = both(query, asked)

    for op, arg in nodes:
        if op is rc.LITERAL:
            add({_fold(arg)}, ANY)
        elif op is rc.AT or op in (rc.ASSERT, rc.ASSERT_NOT):
            continue
        elif op is rc.IN:
            chars: set[bytes] | None = set()
            for kind, value in arg:
                if chars is None or kind not in (rc.LITERAL, rc.RANGE):
                    chars = None
                elif kind is rc.LITERAL:
                    chars.add(_fold(value))
                elif value[1] - value[0] < SET_LIMIT:
                    chars |= {_fold(c) for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
            add(chars if chars and len(chars) <= 12 else None, ANY)
        elif op is rc.SUBPATTERN:
            add(*_analyse(arg[3]))
        elif op is rc.ATOMIC_GROUP:
            add(*_analyse(arg))
        elif op is rc.BRANCH:
            parts = [_analyse(b) for b in arg[1]]
            exact = None if any(e is None for e, _ in parts) else set().union(*(e for e, _ in parts))
            add(exact, either([q if e is None else _of_strings(e) for e, q in parts]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            exact, asked = _analyse(inner)
            if exact is not None and low == 0 and high == 1:
                add(exact | {b""}, ANY)
            elif exact is not None and low == high and len(exact) ** low <= SET_LIMIT:
                for _ in range(low):
                    add(exact, ANY)
            else:
                add(None, ANY if low == 0 else asked if exact is None else _of_strings(exact))
        else:
            add(None, ANY)
    if whole:
        return run, ANY
    return None, both(query, _of_strings(run))


def trigram_query(pattern: str) -> tuple:
    """("any",), ("has", trigram), ("and", q, q) or ("or", q, ..) that holds for every text with a match."""
    exact, query = _analyse(rp.parse(pattern, re.ASCII))
    return _of_strings(exact) if exact is not None else query


def _trigrams(query: tuple) -> set[bytes]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(_trigrams(q) for q in query[1:])) if len(query) > 1 else set()


@dataclass
class Hit:
    row: int
    rule: str
    nth: int
    start: int
    end: int
    text: str


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = [(name, re.compile(p, re.ASCII), trigram_query(p)) for name, p in rules.items()]
        wanted = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in wanted], dtype=np.int32)
        self.slot = {t: i for i, t in enumerate(wanted)}
        self.pairs = np.zeros(1 << 16, dtype=bool)
        self.pairs[self.codes >> 8] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, joined: Joined) -> np.ndarray:
        """Which text (column) has which wanted trigram (row)."""
        out = np.zeros((len(self.codes), joined.n), dtype=bool)
        data = self.lower[joined.data]
        if len(data) < 3 or not len(self.codes):
            return out
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        at = np.flatnonzero(self.pairs[pair[:-1]])
        code = pair[at].astype(np.int32) << 8 | data[at + 2]
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        real = self.codes[slot] == code
        at, slot = at[real], slot[real]
        out[slot, np.searchsorted(joined.starts, at, side="right") - 1] = True
        return out

    def _holds(self, query: tuple, postings: np.ndarray) -> np.ndarray:
        if query[0] == "any":
            return np.ones(postings.shape[1], dtype=bool)
        if query[0] == "has":
            return postings[self.slot[query[1]]]
        parts = [self._holds(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: pa.Array) -> Iterator[Hit]:
        for low, high in pieces(texts):
            part = texts.slice(low, high - low)
            postings = self.postings(Joined(part, separator=0))
            strings: dict[int, str] = {}
            for name, expression, query in self.rules:
                for row in np.flatnonzero(self._holds(query, postings)).tolist():
                    if row not in strings:
                        strings[row] = part[row].as_py() or ""
                    for nth, match in enumerate(expression.finditer(strings[row]), 1):
                        yield Hit(low + row, name, nth, match.start(), match.end(), match.group())


def _scan(rules: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            hits = list(scanner.scan(as_column(batch, "text")))
            rows = pa.array([h.row for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [as_column(batch, "doc_id").take(rows), pa.array([h.rule for h in hits], pa.string()), pa.array([h.nth for h in hits], pa.int32()), pa.array([h.text for h in hits], pa.string())],
                names=["doc_id", "rule", "nth", "secret"],
            )
        give_back()

    return run


def secret_scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, nth, n_chars, fingerprint): every match of every rule, its secret only as an MD5 digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.select("doc_id", "text").mapInArrow(_scan(rules or RULES), f"doc_id {kind}, rule string, nth int, secret string")
    return hits.select("doc_id", "rule", "nth", F.length("secret").alias("n_chars"), F.md5("secret").alias("fingerprint"))


def redact(text: str, hits: list[Hit]) -> str:
    """text with each stretch of overlapping matches replaced by the name of the rule that begins it."""
    out, done = [], 0
    spans = sorted((h.start, -h.end, h.rule) for h in hits)
    i = 0
    while i < len(spans):
        start, end, rule = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, -spans[i][1])
            i += 1
        out += [text[done:start], f"<{rule}>"]
        done = end
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """docs with every secret in text replaced by <rule>; n_chars, if there, follows. All rows stay."""
    rules = rules or WHOLE

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        for texts in batches:
            by_row: dict[int, list[Hit]] = {}
            for hit in scanner.scan(texts):
                by_row.setdefault(hit.row, []).append(hit)
            if not by_row:
                yield texts
                continue
            rows = sorted(by_row)
            mask = np.zeros(len(texts), dtype=bool)
            mask[rows] = True
            new = pa.array([redact(texts[r].as_py(), by_row[r]) for r in rows], texts.type)
            yield pc.replace_with_mask(texts, pa.array(mask), new)
        give_back()

    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    (name,) = fresh(docs.columns, "clean")
    marked = docs.withColumn(name, clean("text"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col(name) != F.col("text"), F.length(name).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    columns["text"] = F.col(name)
    return marked.select(*[c.alias(k) for k, c in columns.items()])


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    each = " UNION ALL ".join(
        f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {quoted(name)} AS rule, regexp_extract_all(text, {quoted(pattern)}) AS found FROM documents WHERE regexp_matches(text, {quoted(pattern)})" for name, pattern in RULES.items()
    )
    return f"""
WITH hits AS ({each}), numbered AS (SELECT doc_id, rule, found, unnest(range(1, len(found) + 1)) AS nth FROM hits)
SELECT doc_id, rule, CAST(nth AS INTEGER) AS nth, CAST(length(found[nth]) AS INTEGER) AS n_chars, md5(found[nth]) AS fingerprint FROM numbered
"""


SQL = _sql()
