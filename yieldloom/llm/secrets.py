"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Patterns are matched leftmost, without overlap within a kind, over the whole text. Beyond them, runs of at
least ``MIN_RUN`` key characters, less what a pattern's span covers, are encoded with a tiktoken vocabulary:
text that the vocabulary knows takes several characters a token, random strings take few, so a run with at
most ``MOST_RATIO`` characters a token is reported as ``random``. Long compounds of natural languages come
down to 1.6, so letters of one case (but for the first) must stay below ``PLAIN_RATIO``. Digests of known
lengths, UUIDs, runs of digits, and identifiers of several words are excluded.

Cases: null text counts as empty; empty texts have no spans; repeated rows are scanned alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from yieldloom.llm.common import slices, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The matches of [0-9a-f]+ that have 32 characters and more.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_RUN, MOST_RATIO, PLAIN_RATIO = 16, 2.0, 1.5
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_LETTER = re.compile(r"[A-Za-z]")
#: Letters of one case, with or without a capital in front.
_PLAIN = re.compile(r"[A-Za-z]?(?:[a-z]+|[A-Z]+)\Z")
#: A word or a number of an identifier such as order_line_2024 or readFileUtf8.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
#: Runs are encoded in parts of this length; a token's end more or less doesn't move a long run's ratio.
_PART = 1 << 12


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, by start then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_name(run: str) -> bool:
    """Several words or numbers joined into an identifier: words of 3 letters and more with a vowel, and at
    least 3.5 characters a piece."""
    pieces = _PIECE.findall(run)
    words = [p for p in pieces if not p.isdigit()]
    return len(pieces) > 1 and bool(words) and all(len(w) > 2 and _VOWEL.search(w) for w in words) and 2 * sum(map(len, pieces)) >= 7 * len(pieces)


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of start:end that no span of ``base`` (sorted by start) covers."""
    out = []
    for s, _, e in base:
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in (*out, (start, end)) if e - s >= MIN_RUN]


def random_spans(text: str, base: list[tuple[int, int, int]], tokens: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        for start, end in _uncovered(m.start(), m.end(), base):
            run = text[start:end]
            if not _LETTER.search(run) or _DIGEST.match(run) or _UUID.match(run) or is_name(run):
                continue
            n = sum(len(tokens.encode_ordinary(run[k : k + _PART])) for k in range(0, len(run), _PART))
            if len(run) <= (PLAIN_RATIO if _PLAIN.match(run) else MOST_RATIO) * n:
                out.append((start, 3, end))
    return out


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of ``docs``. ``ranks``
    is the vocabulary's rank file and ``pattern`` its splitting pattern."""
    longs = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())])

    def run(batches):
        tokens = encoding(ranks, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                cols: list[list] = [[] for _ in range(6)]
                for text in texts(batch.column("text")):
                    base = base_spans(text)
                    more = random_spans(text, base, tokens)
                    for k in range(3):
                        cols[k].append(sum(b[1] == k for b in base))
                    cols[3].append(hashlib.sha256(line(base).encode()).hexdigest())
                    cols[4].append(line(sorted(base + more)))
                    cols[5].append(len(more))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
