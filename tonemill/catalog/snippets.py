"""DuckDB spellings of the shared text rules, written independently of the Spark expressions."""

from __future__ import annotations

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
#: The words of Spark's English stop-word list, which the oracles state for DuckDB.
ENGLISH = """
a about above after again against all am an and any are aren't as at be because been before being below
between both but by can can't cannot could couldn't did didn't do does doesn't doing don don't down during
each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just let's me
more most mustn't my myself no nor not now of off on once only or other ought our ours ourselves out over own
s same shan't she she'd she'll she's should shouldn't so some such t than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've this those through to too under until
up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
who who's whom why why's will with won't would wouldn't you you'd you'll you're you've your yours yourself
yourselves
""".split()
URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(t: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({strip(t)}, '{URL}', '', 'g'), '[{WS}]{{2,}}', ' ', 'g')")


def repair(t: str) -> str:
    first = rf"regexp_replace({t}, '\+([\x{{80}}-\x{{ff}}])', '\1', 'g')"
    return rf"replace(regexp_replace({first}, '\+\+([A-Za-z])', '\1', 'g'), '{chr(0xfffd)}', '')"


def features(stripped: str) -> dict[str, str]:
    return {
        "char_length": f"length({stripped})",
        "word_count": rf"len(regexp_extract_all({stripped}, '[^{WS}]+'))",
        "has_url": f"regexp_matches({stripped}, '{URL}')",
        "has_ticker": rf"regexp_matches({stripped}, '\$[A-Za-z]')",
        "has_number": rf"regexp_matches({stripped}, '(^|[^{WORD}])\p{{Nd}}+($|[^{WORD}])')",
        "has_percent": rf"regexp_matches({stripped}, '(^|[^{WORD}])\p{{Nd}}+([.,]\p{{Nd}}+)?[{WS}]*%')",
        "has_replacement_char": f"contains({stripped}, '{chr(0xfffd)}')",
    }


def count_tokens(t: str, stopwords: list[str] | None = None) -> str:
    plain = f"lower(replace(regexp_replace({t}, '{URL}', ' ', 'g'), '{chr(0x2019)}', ''''))"
    keep = "length(x) >= 2"
    if stopwords:
        keep += " AND x NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in stopwords) + ")"
    return f"list_filter(regexp_extract_all({plain}, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: {keep})"


def lexicon_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z''-]*'), lambda x: upper(x))"


def feature_terms(source: str, keep: str) -> str:
    """Rows (keep..., term): unigrams and bigrams of every text in ``source``."""
    tokens = rf"regexp_extract_all(strip_accents(lower(text)), '[{WORD}]{{2,}}')"
    pairs = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"SELECT {keep}, unnest(list_concat(t, {pairs})) AS term FROM (SELECT {keep}, {tokens} AS t FROM {source})"


def split_ctes(
    source: str, out: str, key: str, names: list[str], fractions: list[float], carry: str = "", where: str = "TRUE"
) -> str:
    """CTEs ranking all rows of a class in seeded hash order against largest-remainder quotas."""
    p = f"{out}_"
    ctes = [f"{p}in AS (SELECT * FROM {source} WHERE {where})"]
    ctes.append(f"{p}q0 AS (SELECT label, count(*) AS n, count(*) AS l, 0::BIGINT AS upto FROM {p}in GROUP BY label)")
    for i, fraction in enumerate(fractions, start=1):
        ctes.append(
            f"{p}t{i} AS (SELECT sum(l) - CAST(ceil(sum(l)::DOUBLE * {fraction}::DOUBLE) AS BIGINT) AS stay, "
            f"sum(l)::DOUBLE AS total FROM {p}q{i - 1})"
        )
        ctes.append(
            f"{p}f{i} AS (SELECT q.*, floor(l / total * stay)::BIGINT AS fl, "
            f"l / total * stay - floor(l / total * stay) AS rest, stay FROM {p}q{i - 1} q, {p}t{i})"
        )
        ctes.append(
            f"{p}k{i} AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) "
            f"<= stay - sum(fl) OVER () THEN 1 ELSE 0 END AS keep FROM {p}f{i})"
        )
        cuts = "".join(f", cut{j}" for j in range(1, i))
        ctes.append(
            f"{p}q{i} AS (SELECT label, n, l - keep AS l, upto + keep AS upto{cuts}, upto + keep AS cut{i} FROM {p}k{i})"
        )
    cases = " ".join(f"WHEN r <= cut{i} THEN '{names[i - 1]}'" for i in range(1, len(fractions) + 1))
    ctes.append(
        f"{p}r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || {key}::VARCHAR), {key}) AS r FROM {p}in)"
    )
    ctes.append(
        f"{out} AS (SELECT {p}r.* EXCLUDE (r), CASE {cases} ELSE '{names[-1]}' END AS split "
        f"FROM {p}r JOIN {p}q{len(fractions)} USING (label))"
    )
    return ",\n".join(ctes)


LABELS = ("positive", "neutral", "negative")


def evaluation(source: str, group: str, extra: str = "") -> str:
    """SELECT of one metric row per group from rows of (group, label, prediction)."""
    keys = ", ".join(g.strip() for g in group.split(","))
    per_label = f"""
      SELECT {keys}, l.label AS lab,
             count(*) FILTER (WHERE e.label = l.label AND e.prediction = l.label)::DOUBLE AS hit,
             count(*) FILTER (WHERE e.label = l.label)::DOUBLE AS sup,
             count(*) FILTER (WHERE e.prediction = l.label)::DOUBLE AS prd
      FROM {source} e CROSS JOIN (VALUES ('positive'), ('neutral'), ('negative')) l(label)
      GROUP BY {keys}, l.label"""
    scored = f"""
      SELECT *, CASE WHEN prd = 0 THEN 0 ELSE hit / prd END AS p, CASE WHEN sup = 0 THEN 0 ELSE hit / sup END AS r,
             CASE WHEN sup + prd = 0 THEN 0 ELSE 2 * hit / (sup + prd) END AS f
      FROM ({per_label})"""
    weighted = "CASE WHEN sum(sup) = 0 THEN 0 ELSE sum({0} * sup) / sum(sup) END"
    means = f"""
      SELECT {keys}, avg(f) AS macro_f1, {weighted.format('f')} AS weighted_f1,
             avg(p) AS macro_precision, {weighted.format('p')} AS weighted_precision,
             avg(r) AS macro_recall, {weighted.format('r')} AS weighted_recall
      FROM ({scored}) GROUP BY {keys}"""
    totals = f"""
      SELECT {keys}, count(*) AS size, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy
      FROM {source} GROUP BY {keys}"""
    return f"SELECT * FROM ({totals}) JOIN ({means}) USING ({keys})"


METRICS = (
    "accuracy", "macro_f1", "weighted_f1", "macro_precision", "weighted_precision", "macro_recall", "weighted_recall",
)


def rounded_metrics(names: tuple[str, ...] = METRICS) -> str:
    return ", ".join(f"round({m}, 6) AS {m}" for m in names)
