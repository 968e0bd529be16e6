"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are assigned values after a telling name, tokens of known forms (key blocks from their first line to their last),
and long mixed tokens, each of any length. The forest sees the length
of a candidate, how its characters follow one another, how much of it a small dictionary covers, the path it was found
under, and the words around it. It is trained here, on labelled findings: a table of (value, path, before, after, is_secret).
``example_findings`` makes such a table of bounded size from the forms that secrets and their look-alikes take; a caller with
reviewed findings of their own passes those instead.
"""

from __future__ import annotations

import base64
import math
import random
import re
import uuid

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = 60
EXAMPLES = 4000
TREES = 40
DEPTH = 8
SEED = 42

# No form has an upper length. Runs of name characters are entered at their start only, and just if an assignment ends them,
# which keeps the search linear in the text.
NAMED = r"(?i:(?<![\w.-])(?=[\w.-]*+[\"']?\s{0,3}[:=])[\w.-]*?(?:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)[\w-]*+[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3})"
CANDIDATE = re.compile(
    rf"(?:{NAMED}(?:\"(?P<quoted>[^\"\n]{{4,}})\"|'(?P<single>[^'\n]{{4,}})'|(?P<bare>[^\s\"'<>,;]{{4,}}+)))"
    r"|(?P<known>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b|\bxox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+"
    r"|-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{40,}+)*+))"
    r"|(?P<mixed>(?<![\w+/@.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_.@-]*+[A-Za-z])[\w+/.@=-]{16,}+)",
    re.A,
)
# Words that programs, configurations and their examples are made of.
DICTIONARY = (
    "access account admin alpha api app auth author backup base beta body branch bucket build cache change changeme client code com "
    "commit common config console content cookie core data database date debug default demo dev develop display docs domain dummy "
    "email enabled encode encrypted endpoint entry env error event example extra fake field file filter fixme foo bar baz format "
    "function general generic github global group handler hash header hello help home host html http https image import index info "
    "input insert internal item java javascript job json key label lang layer library list local localhost login mail main manager "
    "master message method mock model module mongo my mysql name net network node none normal null number object option org output "
    "package page param parent pass password path payload placeholder platform plugin port postgres print private process prod "
    "production profile project property provider proxy public python query queue random read record redis release remote replace "
    "request resource response result role root route sample schema script secret secure select server service session setting "
    "share simple source spring sql stage start state static status storage store stream string style system table target task "
    "template test text time title tmp todo token tool type undefined update upload url user username util utils value var version "
    "view web window word work world write www xml xxx yaml your"
).split()
WORD = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
NAMES_ABOVE = re.compile(r"(?i)passw|pwd|secret|token|key|credential|auth")
HARMLESS = re.compile(r"(?i)example|sample|test|dummy|placeholder|fake|sha\d*|md5|checksum|commit|hash|uuid|guid|digest|etag|revision|build|version")
TEST_PATH = re.compile(r"(?i)test|spec|example|sample|doc|fixture|mock|readme|tutorial")
FEATURES = (
    "length", "digits", "upper", "lower", "other", "class_changes", "case_changes", "entropy", "distinct", "repeats", "runs",
    "vowels", "hex", "covered", "longest_word", "uuid", "at_sign", "dots", "slashes", "markers", "named", "harmless", "path_test",
    "path_depth", "words_near",
)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(value: str, path: str, before: str, after: str) -> list[float]:
    """The features of a finding, in the order of ``FEATURES``."""
    n, low = max(1, len(value)), value.lower()
    kinds = [_kind(c) for c in value]
    counts = {c: value.count(c) for c in set(value)}
    near = re.findall(r"[^\W\d_]{2,}", f"{before[-CONTEXT:]} {after[:CONTEXT]}")
    words = [m[0] for m in WORD.finditer(low)]
    steps = list(zip(kinds, kinds[1:], strict=False))
    return [
        float(len(value)),
        *[kinds.count(k) / n for k in range(4)],
        sum(a != b for a, b in steps) / n,
        sum({a, b} == {1, 2} for a, b in steps) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(value, value[1:], strict=False)) / n,
        sum(c in "aeiou" for c in low) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        sum(map(len, words)) / n,
        float(max(map(len, words), default=0)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float("@" in value),
        value.count(".") / n,
        value.count("/") / n,
        float(bool(re.search(r"[${}<>%\[\]()*]|\.\.\.|x{4,}", low))),
        float(bool(NAMES_ABOVE.search(before[-CONTEXT:]))),
        float(bool(HARMLESS.search(before[-CONTEXT:]) or HARMLESS.search(after[:20]))),
        float(bool(TEST_PATH.search(path or ""))),
        float((path or "").count("/")),
        float(len(near)),
    ]


def findings(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the candidates of a text, from left to right."""
    out = []
    for m in CANDIDATE.finditer(text):
        group = m.lastgroup
        out.append((m.start(group), m.end(group), "named" if group in ("quoted", "single", "bare") else group, m[group]))
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, start, end (code points), kind, value, features: one row per candidate of a whole text; none for null texts.

    Candidates are found from left to right and don't overlap; where two forms start at one place the first of ``CANDIDATE``
    counts. Repeated rows and ids give their candidates once for each row. Other columns are ignored, whatever their names.
    """
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), path.alias("path"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, (text, path) in enumerate(zip(batch["text"], batch["path"], strict=True)):
                whole, under = text.as_py() or "", path.as_py() or ""
                for start, end, kind, value in findings(whole):
                    at.append(i)
                    before, after = whole[max(0, start - CONTEXT) : start], whole[end : end + CONTEXT]
                    found.append((start, end, kind, value, describe(value, under, before, after)))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["doc_id", "start", "end", "kind", "value", "features"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, end long, kind string, value string, features array<double>")


# --- labelled findings ---------------------------------------------------------------------------------------------


def example_findings(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, str, str, float]]:
    """``count`` labelled findings (value, path, before, after, is_secret), half of them secrets, the same for the same seed."""
    rng = random.Random(seed)
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    words = lambda low, high, by: by.join(rng.choice(DICTIONARY) for _ in range(rng.randint(low, high)))
    prose = lambda: " ".join(some(letters, 2, 9) for _ in range(rng.randint(2, 8)))
    secret = [
        lambda: (some("0123456789abcdef", 16, 64), True),
        lambda: (some(mixed, 16, 48), True),
        lambda: ("AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), False),
        lambda: ("ghp_" + some(mixed, 36, 36), False),
        lambda: (base64.b64encode(rng.randbytes(rng.randint(16, 48))).decode(), True),
        lambda: (".".join(["eyJ" + some(mixed, 20, 40), some(mixed, 20, 80), some(mixed + "_-", 30, 43)]), False),
        lambda: (some(mixed + "!#%&*", 10, 20), True),
    ]
    harmless = [
        lambda: (rng.choice(("changeme", "password", "example", "xxxxxxxx", "your_token_here", "secret123", "null", "None", "true", "test1234")), True),
        lambda: (f"{rng.choice(('${', '<', '{{', '%('))}{words(1, 3, '_')}{rng.choice(('}', '>', '}}', ')s'))}", True),
        lambda: (words(2, 4, rng.choice("._-/")) + rng.choice(("", "1", "2024")), rng.random() < 0.5),
        lambda: (str(uuid.UUID(bytes=rng.randbytes(16))), False),
        lambda: (some("0123456789abcdef", 40, 40), None),
        lambda: (f"{some(letters, 3, 8)}.{rng.randint(1, 99)}@{words(1, 2, '.')}{rng.randint(1, 9)}.example.com", False),
        lambda: ("/".join([words(1, 2, "-") for _ in range(rng.randint(3, 5))]) + f"/v{rng.randint(1, 9)}", False),
        lambda: (f"{some(letters, 6, 14)}{rng.randint(1, 9999)}{some(letters, 4, 9)}", False),
        lambda: (f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}-00-00Z", False),
    ]
    out = []
    for i in range(count):
        value, named = rng.choice(harmless if i % 2 else secret)()
        name = rng.choice(("password=", 'token = "', "api_key: ", "secret = '", "access_key=", "PWD="))
        mark = rng.choice(("sha256:", "commit ", "checksum: ", "etag ", "md5 "))
        before = f"{prose()} {name if named else mark if named is None else ''}"
        path = rng.choice(("src0", "", "app/settings.py", "deploy/prod.env", "lib/core/http.go", "notes.txt") if not i % 2 or rng.random() < 0.6 else ("tests/test_api.py", "docs/readme.md", "examples/config.yml"))
        out.append((value, path, before, f" {prose()}", float(not i % 2)))
    return out


def train(spark: SparkSession, labelled: list[tuple[str, str, str, str, float]] | None = None, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest over labelled findings, of which there must be some of both labels."""
    rows = [(describe(v, p, b, a), label) for v, p, b, a, label in (labelled or example_findings())]
    data = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(data.coalesce(1))


def scored(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """The candidates with ``probability`` and ``is_secret``."""
    vectors = found.withColumn("vector", array_to_vector("features"))
    model = model.setFeaturesCol("vector").setProbabilityCol("shares").setRawPredictionCol("votes").setPredictionCol("guess")
    judged = model.transform(vectors).withColumn("probability", vector_to_array("shares")[1])
    return judged.drop("vector", "shares", "votes", "guess").withColumn("is_secret", F.col("probability") >= 0.5)
