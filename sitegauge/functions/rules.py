"""Rules as data: page categories, link rules, keyword lists, number patterns, thresholds.

The word lists, patterns and thresholds are fixed values: results depend on them exactly.
Every rule set can be replaced by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CHARS, WORD_CHARS

# ---------------------------------------------------------------- fixed values: categories
CATEGORIES = ("top", "about", "history", "business", "ir", "recruit", "news", "sustainability")
FEATURE_CATEGORIES = ("top", "about", "history", "business", "ir", "recruit", "news")
FAILED_CATEGORY = "timeout_error"
NO_URL = "NOT_FOUND"
BAD_URLS = ("NOT_FOUND", "ERROR")

# ---------------------------------------------------------------- fixed values: classes
REVENUE_CLASSES = ("S", "A", "B", "C", "D")
REVENUE_FLOORS = (("S", 2_000_000), ("A", 800_000), ("B", 500_000))
REVENUE_REST = "C"
STARTUP_CLASS = "D"
REVENUE_RANGES = {
    "S": "2兆円以上",
    "A": "8000億円〜2兆円未満",
    "B": "5000億円〜8000億円未満",
    "C": "〜5000億円未満",
    "D": "スタートアップ企業",
}
UNKNOWN_RANGE = "不明"
REVENUE_IDS = {"A": 0, "B": 1, "C": 2, "D": 3, "S": 4}
CATEGORY_IDS = {
    "about": 0,
    "business": 1,
    "history": 2,
    "ir": 3,
    "news": 4,
    "recruit": 5,
    "sustainability": 6,
    "top": 7,
}


@dataclass(frozen=True)
class LinkRule:
    """A link belongs to ``category`` when its URL or its text matches; earlier rules win."""

    category: str
    url: str
    text: str


# ---------------------------------------------------------------- fixed values: link rules
LINK_RULES = (
    LinkRule(
        "about",
        "about|company|profile|corporate|message|philosophy|vision",
        "会社|企業|概要|理念|ビジョン|ミッション|メッセージ|ご挨拶|トップ|代表",
    ),
    LinkRule(
        "business",
        "business|service|solution|product|works|case",
        "事業|サービス|ソリューション|製品|プロダクト|実績|事例|強み",
    ),
    LinkRule(
        "sustainability",
        "sustainability|csr|esg|sdgs|environment",
        "サステナビリティ|環境|社会|ガバナンス|sdgs|csr",
    ),
    LinkRule("ir", "ir|investor|finance|highlight", "ir|投資家|財務|業績|決算|ハイライト|株主"),
    LinkRule(
        "recruit",
        "recruit|career|jobs|採用|求人|エントリー",
        "採用|求人|キャリア|働く|新卒|中途",
    ),
    LinkRule("history", "history|沿革|歴史|歩み|創業", "沿革|歴史|歩み|創業"),
    LinkRule(
        "news",
        "news|press|release|info|topics",
        "ニュース|お知らせ|プレスリリース|トピックス|最新情報",
    ),
)


@dataclass(frozen=True)
class CountRule:
    """``log1p`` of how often ``pattern`` matches. Matches may not contain white space."""

    feature: str
    pattern: str


@dataclass(frozen=True)
class UniqueRule:
    """How many different strings match ``pattern``. Matches may not contain white space."""

    feature: str
    pattern: str


@dataclass(frozen=True)
class NumberRule:
    """First number that follows an anchor word.

    ``gap`` is the class of characters allowed between anchor and number and ``max_gap``
    how many of them; ``max_gap=None`` means any distance on the same line. ``anchor`` and
    ``number``+``unit`` may not contain white space, and ``anchor_chars`` bounds the length
    of an anchor.
    """

    feature: str
    anchor: str
    gap: str
    max_gap: int | None
    number: str
    unit: str
    default: float | None = 0.0
    anchor_chars: int = 16


_GAP = f"[{SPACE_CHARS}{WORD_CHARS}]"
_GAP_COLON = f"[{SPACE_CHARS}{WORD_CHARS}:：]"
_LINE = r"[^\n]"

# ---------------------------------------------------------------- fixed values: text features
COUNT_RULES = (
    CountRule(
        "global_word_score",
        "グローバル|global|海外|世界|多国籍|現地|国際|輸出|輸入|北米|アメリカ|欧州|ヨーロッパ|中国"
        "|ASEAN|アジア|中東|アフリカ|オセアニア",
    ),
    CountRule("era_word_score", "明治|大正|昭和|平成|令和"),
    CountRule(
        "ma_word_score",
        "M&A|買収|合併|統合|提携|アライアンス|alliance|パートナー|partner|協業|研究|産学|R&D|共同研究"
        "|イノベーション|innovation|特許|知的財産|大学|TOB|子会社|グループ会社|プライム",
    ),
    CountRule(
        "market_leader_score",
        r"最大手|トップ|top|No\.1|ナンバーワン|リード|リーディングカンパニー|唯一|独自|オンリー|特許"
        "|only|best|首位",
    ),
    CountRule("money_cho_score", "兆円|数兆|兆"),
    CountRule("money_oku_score", "億円|数百億|億"),
    CountRule(
        "welfare_word_score",
        "福利厚生|ワークライフバランス|くるみん|ホワイト|テレワーク|フレックス|ダイバーシティ|女性|育児"
        "|介護|休暇|健康|QOL|健康|DX",
    ),
    CountRule(
        "governance_score",
        "コーポレートガバナンス|コンプライアンス|内部統制|リスクマネジメント|監査|サステナビリティ|SDGs|ESG"
        "|CSR|環境保全|社会貢献|カーボンニュートラル|脱炭素",
    ),
)
UNIQUE_RULES = (
    UniqueRule("num_business_types", "[一-龥]{2,6}事業"),
    UniqueRule("num_job_types", "[一-龥]{2,5}職"),
)
NUMBER_RULES = (
    NumberRule("overseas_sales_ratio", "海外売上(?:高|比率)", _LINE, None, r"[0-9\.]+", "%"),
    NumberRule(
        "global_bases", "(?:海外|世界)(?:拠点)?", _GAP, 10, "[0-9,]+", "(?:ヶ所|箇所|拠点)"
    ),
    NumberRule(
        "founding_year",
        "(?:創業|創立|設立|発祥|始業)",
        _LINE,
        None,
        "(?:18|19|20)[0-9]{2}",
        "年",
        default=None,
    ),
    NumberRule(
        "subsidiaries_count",
        "(?:連結子会社|グループ会社|関係会社)",
        _GAP_COLON,
        10,
        "[0-9,]+",
        "社",
    ),
    NumberRule(
        "partners_count", "(?:提携先|パートナー数|協力会社)", _GAP_COLON, 10, "[0-9,]+", "社"
    ),
    NumberRule("domestic_share_pct", "(?:国内|世界|市場)シェア", _LINE, None, r"[0-9\.]+", "%"),
    NumberRule(
        "employees_count",
        "(?:連結|グループ|正社員|就業|全社)?(?:従業員|人員|社員|スタッフ)(?:数|合計)?",
        _GAP_COLON,
        10,
        "[0-9,]+",
        "(?:名|人)",
    ),
)

# Named groups of feature columns for group-wise study (fixed values).
FEATURE_GROUPS = {
    "configuration": tuple(
        c for p in FEATURE_CATEGORIES for c in (f"has_{p}", f"{p}_length_log", f"{p}_ratio")
    ),
    "global expansion": ("global_word_score", "overseas_sales_ratio", "global_bases"),
    "history & brand": ("era_word_score", "founding_year"),
    "M&A & partnerships": ("ma_word_score", "subsidiaries_count", "partners_count"),
    "market share": ("market_leader_score", "domestic_share_pct"),
    "business scale": ("num_business_types", "money_cho_score", "money_oku_score"),
    "human resources": ("welfare_word_score", "employees_count", "num_job_types"),
    "social responsibility": ("governance_score",),
}


def link_category(url: Column, text: Column, rules: tuple[LinkRule, ...] = LINK_RULES) -> Column:
    """Category of a link from its address and text, or null. Order of the rules matters."""
    url, text = F.lower(url), F.lower(text)
    out: Column | None = None
    for rule in rules:
        hit = url.rlike(rule.url) | text.rlike(rule.text)
        out = F.when(hit, F.lit(rule.category)) if out is None else out.when(hit, F.lit(rule.category))
    return out


def revenue_class(
    revenue: Column,
    floors: tuple[tuple[str, float], ...] = REVENUE_FLOORS,
    rest: str = REVENUE_REST,
) -> Column:
    """Class of a revenue, truncated to whole units first; floors in descending order."""
    whole = revenue.cast("long")
    out: Column | None = None
    for name, floor in floors:
        hit = whole >= F.lit(floor)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(rest))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def decode_label(label_id: Column, ids: dict[str, int] = REVENUE_IDS) -> Column:
    return F.try_element_at(literal_map({v: k for k, v in ids.items()}), label_id)


def range_label(label: Column, ranges: dict[str, str] = REVENUE_RANGES) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ranges), label), F.lit(UNKNOWN_RANGE))
