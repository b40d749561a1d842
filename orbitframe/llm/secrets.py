"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Ordinary words cost a byte-pair vocabulary few tokens, random strings cost it many.  After known digests
and identifiers are set aside, a long run of key characters whose characters per token, under a tiktoken
vocabulary, are few is reported as kind `random`.  One pass over the scan, no exchange.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, texts, tune

#: The driver's rank file, by a setting of the environment; see `shipped`.
VOCABULARY = os.environ.get("ORBITFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Shortest run that the efficiency test looks at, and the characters per token below which it is random.
MIN_RUN = 20
MAX_RATIO = 2.2
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
#: Bytes of the digests that are named in front of them, and lengths of bare hexadecimal ones.
NAMED = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
DIGESTS = frozenset(2 * n for n in NAMED.values())
UUID = re.compile("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
ULID = re.compile("[0-7][0-9A-HJKMNP-TV-Z]{25}")
BARE = re.compile("[0-9a-f]+|[0-9A-F]+")
#: A part of an identifier: letters, then up to 13 digits (as many as an ISBN has); and the words of its letters.
PART = re.compile("([A-Za-z]*)([0-9]{0,13})")
LABEL = 4
CASED = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
#: Bound on the bytes of a vocabulary that is sent to the executors.
VOCABULARY_BYTES = 64_000_000
_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_SHIPPED: dict[str, object] = {}


def _encoding(raw: bytes):
    """A tiktoken encoding of ranks; its pattern takes a whole run as one piece."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return raw


def vocabulary(path: str):
    if path not in _SHIPPED:
        _SHIPPED[path] = _encoding(read_vocabulary(path))
    return _SHIPPED[path]


def shipped(spark: SparkSession, path: str):
    """A function that makes the vocabulary at a path of the driver known where it is called."""
    raw = read_vocabulary(path)
    key = f"{path}:{hashlib.sha256(raw).hexdigest()}"
    held = spark.sparkContext.broadcast(raw)

    return lambda: _install(key, held)


def _install(key: str, held) -> str:
    if key not in _SHIPPED:
        _SHIPPED[key] = _encoding(held.value)
    return key


def tokens(run: str, path: str) -> int:
    """Tokens of a run, encoded in stretches of 256 characters: a single piece's cost grows faster than its length."""
    return sum(len(vocabulary(path).encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256))


def digest(run: str) -> bool:
    """Hexadecimal digests of known lengths, and digests in hexadecimal or base64 after their name."""
    if len(run) in DIGESTS and BARE.fullmatch(run):
        return True
    name, _, rest = run.partition("-")
    size = NAMED.get(name)
    if not size:
        return False
    core = rest.rstrip("=")
    whole = len(rest) in (len(core), -(-size // 3) * 4)
    return bool(len(rest) == 2 * size and re.fullmatch("[0-9a-f]+", rest) or (whole and len(core) == (size * 8 + 5) // 6 and re.fullmatch("[A-Za-z0-9+/_-]+", core)))


def identifier(run: str, path: str, ratio: float) -> bool:
    """Two parts or more, each letters and then digits, whose words cost the vocabulary few tokens; or numbers with a label of up to LABEL letters."""
    parts = re.split("[-_/+=]", run)
    if sum(map(bool, parts)) < 2:
        return False
    words = []
    for part in parts:
        m = PART.fullmatch(part)
        if not m:
            return False
        words += CASED.findall(m[1])
    letters = sum(map(len, words))
    return letters <= LABEL or letters >= ratio * sum(tokens(w.lower(), path) for w in words)


def known(run: str, path: str = VOCABULARY, ratio: float = MAX_RATIO) -> bool:
    """Digests, UUIDs, ULIDs, plain numbers, rulers such as ====, and identifiers whose parts are words or numbers (paths, branches, ISBNs)."""
    return len(set(run)) < 6 or run.isdigit() or bool(UUID.fullmatch(run) or ULID.fullmatch(run)) or digest(run) or identifier(run, path, ratio)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def random_spans(text: str, path: str = VOCABULARY, ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) < ratio * tokens(run, path) and not known(run, path, ratio):
            out.append(("random", m.start(), m.end()))
    return out


def all_spans(text: str, path: str = VOCABULARY, ratio: float = MAX_RATIO) -> tuple[list, list]:
    """(base, base and the method's): a random run that a base span overlaps adds nothing."""
    base = base_spans(text)
    extra = [x for x in random_spans(text, path, ratio) if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
    return base, sorted(base + extra, key=lambda x: (x[1], (*KINDS, "random").index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan(docs: DataFrame, path: str = VOCABULARY, ratio: float = MAX_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points) and n_random, a row for each of docs.

    The span of `assign` is its whole match.  Null texts are empty and have no spans.  Repeated rows give repeated rows, a null
    id stays null, other columns are left out.  `path` is a tiktoken rank file that the driver can open; it is sent along.
    """
    install = shipped(docs.sparkSession, path)

    def run(part: pa.RecordBatch) -> dict:
        own = install()
        found = [all_spans(t, own, ratio) for t in texts(part.column(1))]
        out = {f"n_{k}": [sum(s[0] == k for s in b) for b, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [_joined(a) for _, a in found]
        out["n_random"] = [sum(s[0] == "random" for s in a) for _, a in found]
        return out

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(out, ["doc_id", "text"], run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def masked(text: str, path: str = VOCABULARY, ratio: float = MAX_RATIO) -> str:
    """The text with each stretch that spans cover replaced by [SECRET]."""
    out, at = [], 0
    for _, a, z in all_spans(text, path, ratio)[1]:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*out, text[at:]]) if at else text


def mask(docs: DataFrame, path: str = VOCABULARY, ratio: float = MAX_RATIO, text_col: str = "text") -> DataFrame:
    """docs with secrets in the texts masked; null texts stay null, and nothing else changes."""
    install = shipped(docs.sparkSession, path)

    @F.pandas_udf("string")
    def hide(text: pd.Series) -> pd.Series:
        own = install()
        return pd.Series([None if t is None else masked(t, own, ratio) for t in text], dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return scan(table(spark, sf_dir, "documents"))
