"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive places.

The patterns give the base spans. Beside them, each string of 16 characters or more in a sensitive place is a candidate: a sensitive word is in it, ends at
most 48 characters before it or starts at most 32 behind it, or it begins like a known kind of key, or it stands between the ``:`` and the ``@`` of an
address. A candidate is measured by how many bytes it adds to the compressed surroundings, with a compressor primed by a dictionary of code and identifiers.
The surroundings hold plain text, what stands before and after (without copies of the candidate: a secret given twice is no less a secret), and the candidate's own identifiers, that is its
parts between punctuation that are numbers or read like words. Names, paths, dates and long words are thereby in the surroundings or the dictionary and add few bytes; a
random string adds nearly as many as it has. Those above ``novelty`` bytes a character are reported as kind ``novel``, from their left edge to their ends however long, with the lines
right below them that are nothing but such a string too (key blocks): one span for a block. What was measured, in base spans too, is reported with its novelty.

Defined results: a null text counts as empty and has no spans; null ids and repeated rows give a row each; texts of any length are read whole; a string in reach of
several words is one candidate; of overlapping candidates and blocks the first counts; an empty table gives an empty result; extra columns are not returned by
scan_secrets and kept by redact_secrets. Offsets are code points of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# The base patterns, and the least length of what they match (for assign, of group 2).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "novel")
# Words near which a string may be a secret, anywhere and as words of their own.
SENSITIVE = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "api key", "credential", "bearer", "authorization", "private_key", "private key", "private-key", "access_key", "access key", "accesskey", "accountkey", "account_key", "client_key", "signing_key", "signing key", "encryption_key", "encryption key", "session_id", "sessionid", "session id", "connection string", "connectionstring", "webhook", "signature", "ssh-rsa", "ssh-ed25519")
SENSITIVE_WORDS = ("key", "auth", "jwt", "otp", "dsn", "salt", "login", "cookie")
# How well-known kinds of keys begin.
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xapp-", "eyJ", "AIza", "ya29.", "SG.", "npm_", "pypi-", "hf_", "shpat_", "dop_v1_", "AAAAB3Nza", "AAAAC3Nza")
# What the compressor knows beforehand.
CODE = (
    "import os, sys, json, logging; from typing import Any\nclass Client(object):\n    def __init__(self, host, port, username, password, timeout=30):\n        self.session = requests.Session()\n"
    "const config = require('./config'); module.exports = { database: process.env.DATABASE_URL, username: '', password: '' };\npublic static final String DEFAULT_CONFIGURATION_PROPERTIES = new StringBuilder().append(\n"
    "application/json content-type authorization: bearer <token> api_key=your_api_key_here secret_key access_key_id client_secret refresh_token access_token private_key public_key session_token\n"
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 changeme password123 example.com localhost 127.0.0.1 http://www. https://api. /usr/local/bin /etc/passwd\n"
    "get_current_user_permissions create_database_connection validate_request_parameters configuration_manager initialize_application environment_variables authentication_handler serialization_context\n"
)
# Plain text, so that the cost of common letters is known to the compressor in short surroundings too.
PLAIN = (
    "It is a truth that words of many kinds stand here: names, verbs, and numbers like 10, 25 and 1999, in English, en français avec des mots, auf Deutsch mit langen Worten, y en castellano con otras palabras. "
    "for index in range(len(values)): result.append(transform(values[index], options))  # See README.md, Section 4.2; MAX_SIZE = 1024\n"
    "The Quick Brown Fox Jumps Over The Lazy Dog; Kind Regards, Maria Schmidt. function getValue(object, key) { return object[key] || DEFAULT_VALUE; }\n"
)
_ANY = re.compile("|".join(map(re.escape, SENSITIVE)) + "|(?<![a-z])(?:" + "|".join(SENSITIVE_WORDS) + ")(?![a-z])", re.IGNORECASE | re.ASCII)
_STRING = re.compile(r"[A-Za-z0-9+/_~.-]{16,}={0,2}")
_LOOSE = ".~-"
_SEPARATOR, _RUN = re.compile(r"([^A-Za-z0-9]+)"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_BREAK = re.compile(r"""["',;+\\ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>*#"']*""")
_LINE = re.compile(r"""[A-Za-z0-9+/_=~.-]+(?=[ \t]*(?:["',;+\\<\r\n]|\Z))""")
_REACH, _BEHIND, _BEFORE, _AFTER, _LEAST = 48, 32, 256, 128, 16


def is_identifier(part: str) -> bool:
    """Whether a run of ASCII letters and digits is short, a number, or made of pieces that read like words."""
    if len(part) <= 3 or part.isdigit():
        return True
    runs = _RUN.findall(part)
    if 2 * len(part) < 7 * len(runs):
        return False
    return all(len(r) <= 3 or r.isdigit() or 4 * len(r) <= 20 * sum(c in "aeiouy" for c in r.lower()) <= 15 * len(r) for r in runs)


def identifiers(string: str) -> str:
    """The string with a space for each part between punctuation that is no identifier."""
    return "".join(x if k % 2 or is_identifier(x) else " " for k, x in enumerate(_SEPARATOR.split(string)))


class Novelty:
    """Marginal compressed bytes of a string, per character, in its surroundings."""

    def __init__(self, dictionary: str = CODE, level: int = 19):
        self.primed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)

    def __call__(self, before: str, string: str, after: str) -> float:
        rest = f"{PLAIN}{before.replace(string, '')}{after.replace(string, '')} {identifiers(string)} ".encode()
        return (len(self.primed.compress(rest + string.encode())) - len(self.primed.compress(rest))) / len(string)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns match; a kind is its place in KINDS."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def lines_below(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The string from start to end and the lines right below it that are a string each. A line too short to be measured is the last one, and
    only of lines that are equally long, if it is no word, or that a line of dashes closes."""
    lines, width, even = [(start, end)], end - start, False
    while (gap := _BREAK.match(text, lines[-1][1])) and (line := _LINE.match(text, gap.end())) and not line[0].startswith("-----"):
        s, e = line.span()
        if e - s < _LEAST:
            closed = (after := _BREAK.match(text, e)) and text.startswith("-----", after.end())
            return [*lines, (s, e)] if closed or even and e - s < width and not is_identifier(text[s:e]) else lines
        width, even = e - s, e - s == width
        lines.append((s, e))
    return lines


def block_end(text: str, start: int, end: int, measure: Novelty, novelty: float, measured: list[tuple[int, int, float]]) -> int:
    """Where the incompressible lines from this string on end; start if there are none. The lines are measured in the surroundings
    of them all: next to each other they would make one another cheaper."""
    lines = lines_below(text, start, end)
    before, after = text[max(0, start - _BEFORE) : start], text[lines[-1][1] : lines[-1][1] + _AFTER]
    done = start
    for s, e in lines:
        if e - s >= _LEAST:
            measured.append((s, e, measure(before, text[s:e], after)))
            if measured[-1][2] < novelty:
                break
        done = e
    return done


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The strings in sensitive places."""
    low = text.lower()
    some = any(k in low for k in SENSITIVE) or any(k in low for k in SENSITIVE_WORDS)
    if not some and "@" not in text and not any(k in text for k in PREFIXES):
        return
    words = [m.span() for m in _ANY.finditer(text)] if some else []
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in _STRING.finditer(text):
        s, e = m.span()
        s, e = s + len(m[0]) - len(m[0].lstrip(_LOOSE)), e - len(m[0]) + len(m[0].rstrip(_LOOSE))
        if e - s < _LEAST:
            continue
        before, behind = bisect_left(ends, s - _REACH), bisect_left(starts, e)
        near = before < len(ends) and ends[before] <= e or behind < len(starts) and starts[behind] <= e + _BEHIND
        if near or text.startswith(PREFIXES, s) or text[s - 1 : s] == ":" and text[e : e + 1] == "@":
            yield s, e


def novel_spans(text: str, base: list[tuple[int, int, int]], measure: Novelty, novelty: float, measured: list[tuple[int, int, float]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the incompressible candidates and blocks that no base span holds wholly; measured takes (start, end, novelty) of all."""
    found, taken, covered, measured = [], 0, sorted((s, e) for s, _, e in base), [] if measured is None else measured
    for s, e in candidates(text):
        if s < taken:
            continue
        end = block_end(text, s, e, measure, novelty, measured)
        taken = max(e, end)
        if end > s and not any(a <= s and end <= b for a, b in covered):
            found.append((s, 3, end))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, novelty string"


def scan_secrets(docs: DataFrame, novelty: float = 0.5) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, all spans as kind:start:end, and all that was measured as start:end:novelty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            out = []
            for text in batch["text"]:
                t = text.as_py() or ""
                base = base_spans(t)
                measured: list[tuple[int, int, float]] = []
                every = base + novel_spans(t, base, measure, novelty, measured)
                counts = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), ",".join(f"{s}:{e}:{x:.3f}" for s, e, x in measured)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "novelty"])

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def redact(text: str | None, spans: str, mark: str = "<secret>") -> str | None:
    """The text with each of the spans (as scan_secrets writes them) replaced by the mark; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, novelty: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """The same documents and columns; every span of a secret in text is replaced by the mark. n_chars, if there is one, follows where a text
    changed; nothing else changes."""
    types = {f.name: f.dataType for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            texts = []
            for text in batch["text"]:
                t = text.as_py()
                base = base_spans(t or "")
                texts.append(redact(t, _joined(base + novel_spans(t or "", base, measure, novelty)), mark))
            at = batch.schema.get_field_index("text")
            changed = [a is not None and a != b for a, b in zip(texts, batch["text"].to_pylist())]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in types and any(changed):
                at = batch.schema.get_field_index("n_chars")
                sizes = [len(t) if c else n for t, c, n in zip(texts, changed, batch["n_chars"].to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    if "text" not in types:
        raise ValueError("documents need a column text")
    return docs.mapInArrow(run, docs.schema)
