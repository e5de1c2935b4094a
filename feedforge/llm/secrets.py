"""Secret scans with a token-efficiency test (operator 13).

Three kinds of spans follow fixed patterns: values assigned to names of secrets, access keys, and long
hexadecimal strings. The method adds the kind `random`: unbroken runs of RUN characters and more that
a vocabulary trained on ordinary text can't shorten. Words and the identifiers made of them take a
token for several characters, random strings one for less than LIMIT. Left out are runs that mix
neither letters with digits nor cases, known digests (hexadecimal strings as long as those of MD5 and
the SHA family, with or without their algorithm's name), known identifiers (UUIDs, time stamps, dotted
or dashed numbers), and runs that touch a span of the three kinds, which stands for them.

Texts are scanned where they are, one at a time; nothing is shuffled. Places count code points, ends
are exclusive. Patterns run over a whole text of any length; a prefilter by the same patterns only
saves texts without any match from a second look.

Edge cases: null and empty texts have no spans; repeated rows and repeated ids are scanned each on its
own; a null id stays null; spans that start together go by kind in the order of KINDS; an empty table
gives an empty result; columns beyond those named are left aside (redact_secrets keeps them).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import slices

#: Kinds in the order in which spans that start together go.
KINDS = ["assign", "access", "hex", "random"]
#: Fixed patterns; runs are maximal, so that their least lengths can stand in them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of a run that is put to the test, and characters a token below which it counts as random.
RUN, LIMIT = 16, 2.0
_RUNS = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
_SEPARATORS = re.compile(r"[+/_=-]+")
#: Lengths in hexadecimal digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST = re.compile(r"(?:(?:md5|sha-?(?:1|224|256|384|512))[-_=/]?)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_IDENTIFIER = re.compile(
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # UUID
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]{2}-?[0-9]{2}-?[0-9]{2}Z?"  # time stamp
    r"|[A-Za-z]{0,4}[-_=+/]*[0-9]+(?:[-_=+/]+[0-9]+)*[-_=+/]*",  # numbers with dashes, prefixed at most
    re.IGNORECASE,
)
#: What a text with any span must contain; of RE2, which scans many texts in one call.
_ANY = rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|[A-Za-z0-9+/_=-]{{{RUN}}}"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    """A vocabulary of ranks, once a worker."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def efficiency(run: str, vocabulary: str) -> float:
    """Characters a token, separators aside: they part the words of an identifier and say nothing of a secret."""
    bare = _SEPARATORS.sub("", run)
    return len(bare) / max(1, len(_encoding(vocabulary).encode_ordinary(bare)))


def mixed(run: str) -> bool:
    """Letters with digits, or at least three of either case."""
    digits, upper, lower = (len(re.findall(c, run)) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    return bool(digits and upper + lower) or min(upper, lower) >= 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str, limit: float = LIMIT) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs that the vocabulary can't shorten, clear of the sorted spans given."""
    out, at, reach = [], 0, -1
    for m in _RUNS.finditer(text):
        run = m.group()
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach > m.start() or not mixed(run) or _DIGEST.fullmatch(run) or _IDENTIFIER.fullmatch(run):
            continue
        if efficiency(run, vocabulary) < limit:
            out.append((m.start(), 3, m.end()))
    return out


def spans_of(text: str, vocabulary: str, limit: float = LIMIT) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, vocabulary, limit))


SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def scan_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """id and spans (kind, start, stop) of every row, by start and then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = pc.fill_null(batch.column(1), "")
            looked = [spans_of(t, vocabulary, limit) if hit else [] for t, hit in zip(texts.to_pylist(), pc.match_substring_regex(texts, _ANY).to_pylist(), strict=True)]
            found = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in s] for s in looked]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with `[kind]` in place of each stretch that spans cover, named by the first of them."""
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The same rows and columns with secrets replaced; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            new = [None if t is None else redacted(t, spans_of(t, vocabulary, limit)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
