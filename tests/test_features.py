"""Rule-based features against a plain computation on the joined text."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sitegauge.functions.rules import (
    COUNT_RULES,
    FEATURE_CATEGORIES,
    NUMBER_RULES,
    UNIQUE_RULES,
    CountRule,
    NumberRule,
    UniqueRule,
)
from sitegauge.operators import features
from sitegauge.operators.features import count_matches, structural_features

SCHEMA = "company string, category string, seq long, text string"


def pattern_of(rule):
    reach = "*" if rule.max_gap is None else f"{{0,{rule.max_gap}}}"
    gap = r"[^\n]" if rule.max_gap is None else (r"[\s\w:：]" if "：" in rule.gap else r"[\s\w]")
    return f"{rule.anchor}{gap}{reach}?({rule.number}){rule.unit}"


def expected(rows, categories):
    texts = {c: " ".join(t for _, cat, _, t in sorted(rows, key=lambda r: r[2]) if cat == c) for c in categories}
    whole = " ".join(texts.values())
    out = {}
    for c, t in texts.items():
        out[f"has_{c}"] = int(len(t) > 0)
        out[f"{c}_length_log"] = math.log1p(len(t))
        out[f"{c}_ratio"] = len(t) / (len(whole) + 1)
    for r in COUNT_RULES:
        out[r.feature] = math.log1p(len(re.findall(r.pattern, whole)))
    for r in UNIQUE_RULES:
        out[r.feature] = len(set(re.findall(r.pattern, whole)))
    for r in NUMBER_RULES:
        m = re.search(pattern_of(r), whole)
        value = r.default
        if m:
            try:
                value = float(re.sub(r"[^\d.]", "", m.group(1)))
            except ValueError:
                pass
        out[r.feature] = value
    return out


def check(spark, rows, categories=FEATURE_CATEGORIES, **kw):
    df = structural_features(spark.createDataFrame(rows, SCHEMA), "company", "category", "seq", "text", categories, **kw)
    got = {r["company"]: r.asDict() for r in df.collect()}
    companies = {r[0] for r in rows}
    assert set(got) == companies
    for company in companies:
        want = expected([r for r in rows if r[0] == company], categories)
        for feature, value in want.items():
            if isinstance(value, float):
                assert got[company][feature] == pytest.approx(value, abs=1e-12), (company, feature)
            else:
                assert got[company][feature] == value, (company, feature)


def test_known_sentences(spark):
    text = "海外拠点は約 1,234拠点 従業員数：70,710名 国内シェア約45.6% 創業は1937年 自動車事業 金融事業 自動車事業 技術職"
    rows = [("A", "top", 1, text), ("B", "about", 2, "海外売上高は 1.2.3% 海外売上高は 40%"), ("C", "timeout_error", 3, "")]
    df = structural_features(spark.createDataFrame(rows, SCHEMA), "company", "category", "seq", "text")
    got = {r["company"]: r for r in df.collect()}
    a = got["A"]
    assert (a["global_bases"], a["employees_count"], a["domestic_share_pct"]) == (1234.0, 70710.0, 45.6)
    assert (a["founding_year"], a["num_business_types"], a["num_job_types"]) == (1937.0, 2, 1)
    # One try only: an unparsable first match gives the default, the second match is not used.
    assert got["B"]["overseas_sales_ratio"] == 0.0
    assert got["C"]["founding_year"] is None and got["C"]["has_top"] == 0
    check(spark, rows)


def test_number_across_records_and_categories(spark):
    rows = [
        ("A", "about", 5, "創業以来の歩み"),
        ("A", "news", 1, "2023年のお知らせ"),
        ("A", "top", 9, "連結子会社"),
        ("A", "top", 10, "は"),
        ("A", "top", 11, "12社"),
        ("B", "top", 2, "創業以来の歩み\n"),
        ("B", "news", 3, "2023年のお知らせ"),
        ("C", "top", 4, "パートナー数"),
        ("C", "recruit", 6, "77社"),
    ]
    check(spark, rows)


WORDS = (
    "海外 世界拠点 拠点 12 3,4 , . 1.5 45% % シェア 国内シェア 海外売上高 海外売上比率 創業 設立 1937年 2001 年 連結子会社 社 8社 "
    "協力会社 従業員 社員数合計 人 99名 ： : は の \n と 新規事業 自動車事業 総合職 兆円 数兆 億 健康 提携先 提携 グローバル a 特許"
).split(" ")


@pytest.mark.parametrize("seed", range(6))
def test_random_records(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        words = [r.choice(WORDS) for _ in range(r.choice([0, 1, 1, 2, 3, 6]))]
        text = "".join(w + r.choice(["", "", " "]) for w in words)
        category = r.choice([*FEATURE_CATEGORIES[:4], "timeout_error"])
        rows.append((f"c{r.randrange(60)}", category, i, text))
    r.shuffle(rows)
    # Small blocks, so that numbers cross blocks and runs of blocks too.
    check(spark, rows, block_rows=r.choice([2, 3, 7, 1000]))


def test_one_company_holds_nearly_everything(spark):
    r = random.Random(7)
    rows = [("hot", r.choice(FEATURE_CATEGORIES), i, "".join(r.choice(WORDS[:20]) for _ in range(3))) for i in range(900)]
    rows += [("cold", "top", 1000 + i, "創業 1950年") for i in range(3)]
    check(spark, rows, block_rows=5)


def test_word_counts_equal_the_plain_search(spark):
    r = random.Random(1)
    patterns = [rule.pattern for rule in COUNT_RULES] + ["aba|ab", "aa", "a|ba", "ITサービス|IT", "[0-9]+|a", "No\\.1|x", "é|ab"]
    for pattern in patterns:
        words = [w.replace("\\", "") for w in pattern.split("|")]
        pieces = words + [w[:-1] for w in words] + [w[1:] for w in words] + ["x", "の", " ", "a", "1"]
        texts = ["".join(r.choice(pieces) for _ in range(14)) for _ in range(150)]
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [x.n for x in rows.select(count_matches(F.col("t"), pattern).alias("n")).collect()]
        assert got == [len(re.findall(pattern, t)) for t in texts], pattern


def test_rules_with_white_space_are_refused(spark):
    rows = spark.createDataFrame([("A", "top", 1, "x")], SCHEMA)
    with pytest.raises(ValueError):
        structural_features(rows, "company", "category", "seq", "text", count_rules=(CountRule("f", "a b"),))


def test_no_python_in_the_plan_and_one_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    spark.createDataFrame([("A", "top", 1, "x")], SCHEMA).write.parquet(path)
    df = structural_features(spark.read.parquet(path), "company", "category", "seq", "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    # The text is read once; the other scans read keys and positions.
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:", plan)) == 1


def test_patterns_searched_by_arrow_find_what_sparks_find(spark):
    texts = [None, "", "the cat", "the\nthe 12", "海外 34 the", "a\x85the\x0b5", "thethe\u3000 7 😀 the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
    rule = NumberRule("n", "(?:the|海外)", r"[\s\x0B\x85\p{Z}]", 10, "[0-9]+", "")
    found = features._searched(frame, "text", {"many": "the|海外"}, {"stretch": features._stretch(rule)})
    spark_finds = F.coalesce(features._anchored(F.col("text"), rule), F.lit(""))
    rows = found.select("*", F.regexp_count("text", F.lit("the|海外")).alias("n"), spark_finds.alias("s")).collect()
    assert [(r.many, r.stretch) for r in rows] == [(r.n, r.s) for r in rows] and any(r.stretch for r in rows)
    kept = (r"\bthe", "a.b", "^a", "[a-z&&[^b]]", "(a)", "a++", r"\s", "(?i)a", "a(?=b)", "a{2000}")
    assert not any(map(features._alike, kept)) and all(map(features._alike, (r"No\.1|a", "[^\n]{1,2}", r"\p{L}x")))


def test_terms_of_a_block_are_told_apart_by_hash(spark):
    terms = features._distinct_terms(F.col("text"), 3, UniqueRule("u", "[a-z]+"))
    frame = spark.createDataFrame([("b a b 3",)], "text string").select(terms.alias("terms"))
    assert frame.schema["terms"].dataType.simpleString() == "array<string>"
    assert frame.first().terms == ["3 b", "3 a"]
