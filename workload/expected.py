"""The registered queries as plain SQL for an independent engine (DuckDB).

Nothing here calls the library; it shares only fixed values: the view texts and
the constants that are part of the results (patterns, messages, weights).
Columns are spelled out from the view definitions.
"""

from __future__ import annotations

import re

from plumbline.functions import constants as k
from workload import views
from workload.queries import AS_OF, CONTENT_TYPES

# ---- helpers ------------------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = text(k.WHITESPACE)


def ratio(part: str, whole: str, scale: int) -> str:
    return f"((({part}) * {2 * scale} + ({whole})) // (2 * ({whole})))::double / {scale}"


def pct(part: str, whole: str = "rows") -> str:
    return ratio(f"({part}) * 100", whole, 100)


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', round_even(({x})::double, {digits}))"


def fill(template: str, **slots: str) -> str:
    out, position = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append(text(template[position : m.start()]))
        out.append(f"coalesce(({slots[m.group(1)]})::varchar, 'None')")
        position = m.end()
    out.append(text(template[position:]))
    return " || ".join(o for o in out if o != "''")


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {text(pattern)})"


# ---- tables -------------------------------------------------------------------------

S, I, D, B = "string", "integral", "fractional", "boolean"
CUSTOMER = {
    "customer_id": I, "customer_name": S, "email": S, "phone_number": S, "signup_date": S,
    "age": I, "total_spend": D, "discount_rate": D, "tenant_status": S, "region_flag": S,
    "notes": S, "mostly_null": S, "comment": S, "mixed": S,
}
ORDER = {
    "order_id": I, "discount_pct": S, "error_rate": D, "quantity": I, "order_date": S,
    "delivery_time": S, "updated_at": S, "is_priority": B, "answer": S, "contact": S,
    "mobile": S, "priority": S, "balance": D,
}
LINEITEM = {
    "l_orderkey": I, "l_partkey": I, "l_suppkey": I, "l_linenumber": I, "l_quantity": D,
    "l_extendedprice": D, "l_discount": D, "l_tax": D, "l_returnflag": S, "l_linestatus": S,
    "l_shipdate": "temporal",
}
DOCUMENTS = {"doc_id": I, "text": S, "lang": S, "source": S, "n_chars": I}
EVENTS = {"event_id": I, "value": D, "user_id": I}

C = f"with t as materialized ({views.DIRTY_CUSTOMER})"
O = f"with t as materialized ({views.DIRTY_ORDER})"  # noqa: E741
L = "with t as (select * from lineitem)"
DOC = "with t as (select * from documents)"
EV = "with t as (select * from events)"

# ---- facts --------------------------------------------------------------------------


def parsed(s: str) -> str:
    iso = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']"
    named = "['%d %b %Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y']"
    return (
        f"case when {matches(s, k.DATE_ISO)} then try_strptime(replace({s}, '/', '-'), {iso}) "
        f"when {matches(s, k.DATE_DELIMITED)} then "
        f"try_strptime(replace({s}, '-', '/'), ['%m/%d/%Y', '%d/%m/%Y']) "
        f"when {matches(s, k.DATE_NAMED)} then try_strptime({s}, {named}) end"
    )


def repetitive(s: str) -> str:
    one = f"length({s}) >= 5 and length(replace({s}, left({s}, 1), '')) = 0"
    tokens = f"regexp_extract_all(lower({s}), '[\\pL\\pN_]+|\\s+|[^\\pL\\pN_\\s]+')"
    triple = (
        "len(list_filter(range(1, len(tok) - 3), lambda i: tok[i] = tok[i + 2] and "
        "tok[i] = tok[i + 4] and regexp_full_match(tok[i], '[\\pL\\pN_]+') and "
        "trim(tok[i + 1], " + WS + ") = '' and trim(tok[i + 3], " + WS + ") = '')) > 0"
    )
    return f"(({one}) or (select {triple} from (select {tokens} as tok)))"


STRING_FACTS = {
    "blank": f"count(*) filter (where {strip('v')} = '')",
    "len_min": "min(length(v))",
    "len_max": "max(length(v))",
    "len_sum": "sum(length(v))",
    "len_mean": "avg(length(v))",
    "len_sd": "coalesce(stddev_samp(length(v)), 0)",
    "short_numbers": f"count(*) filter (where {matches(strip('v'), k.SHORT_NUMBER)})",
    "iso": f"count(*) filter (where {matches(strip('v'), k.DATE_ISO)})",
    "delimited": f"count(*) filter (where {matches(strip('v'), k.DATE_DELIMITED)})",
    "named": f"count(*) filter (where {matches(strip('v'), k.DATE_NAMED)})",
    "dates": f"count({parsed(strip('v'))})",
    "dates_in_range": f"count(*) filter (where year({parsed(strip('v'))}) between 1800 and 2100)",
    "stamps_ok": f"count(*) filter (where year({parsed(strip('v'))}) between 1800 and 2150)",
    "earliest": f"strftime(min({parsed(strip('v'))}), '%Y-%m-%d %H:%M:%S')",
    "latest": f"strftime(max({parsed(strip('v'))}), '%Y-%m-%d %H:%M:%S')",
    "words": "list_sort(list_distinct(list(lower(v))))[1:3]",
    "at_sign": "count(*) filter (where contains(v, '@'))",
    "email_ok": f"count(*) filter (where {matches(strip('v'), k.EMAIL_STRICT)})",
    "phone_ok": f"count(*) filter (where {matches(strip('v'), k.PHONE_CHARACTERS)} and "
    f"length(regexp_replace({strip('v')}, '\\D', '', 'g')) between 7 and 15)",
    "near_empty": f"count(*) filter (where length({strip('v')}) <= 1)",
    "badly_spaced": f"count(*) filter (where v <> {strip('v')} or contains(v, '  ') or "
    "contains(v, chr(10)) or contains(v, chr(13)) or contains(v, chr(9)))",
    "repetitive": f"count(*) filter (where {repetitive(strip('v'))})",
}
NUMBER_FACTS = {
    "mn": "min(v)::double",
    "mx": "max(v)::double",
    "mean": "avg(v)::double",
    "sd": "stddev_samp(v)::double",
    "q25": "quantile_cont(v::double, 0.25)",
    "q50": "quantile_cont(v::double, 0.5)",
    "q75": "quantile_cont(v::double, 0.75)",
    "negatives": "count(*) filter (where v < 0)",
    "off_percent": "count(*) filter (where v < 0 or v > 100)",
}
NULL_TYPES = {"earliest": "varchar", "latest": "varchar", "words": "varchar[]"}
DOUBLES = ("len_mean", "len_sd", "mn", "mx", "mean", "sd", "q25", "q50", "q75")
COUNTS = {"unique": "uniq", "top": "top", "repeated": "repeated"}


def facts(columns: dict[str, str], *names: str, dataset: str = "dirty_customer") -> str:
    """A CTE f with one row per column and the named facts."""
    names = names or tuple(STRING_FACTS) + tuple(NUMBER_FACTS) + tuple(COUNTS)
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        values = []
        for n in names:
            if n in STRING_FACTS:
                sql = STRING_FACTS[n] if kind == S else None
            elif n in NUMBER_FACTS:
                sql = NUMBER_FACTS[n] if kind in (I, D) else None
            elif n == "unique":
                sql = "count(distinct v)"
            elif n == "top":
                sql = f'(select max(n) from (select count(*) n from t where "{c}" is not null group by "{c}"))'
            elif n == "repeated":
                sql = f'(select sum(n) from (select count(*) n from t where "{c}" is not null group by "{c}") where n > 1)'
            elif n == "shown":
                sql = "min(v)::varchar"
            else:
                raise KeyError(n)
            as_type = NULL_TYPES.get(n, "double" if n in DOUBLES else "bigint")
            values.append(f'{sql or f"null::{as_type}"} as "{n}"')
        parts.append(
            f"select '{dataset}' dataset_id, {i} ordinal, '{c}' \"column\", '{kind}' kind, "
            f"count(*) as rows, count(v) as non_null"
            + "".join(", " + v for v in values)
            + f' from (select "{c}" as v from t)'
        )
    return "f as materialized (" + " union all ".join(parts) + ")"


# ---- issues -------------------------------------------------------------------------

MISSING = "(rows - non_null + coalesce(blank, 0))"
SHARE = pct(MISSING)
CONSTANT = '("unique" = 1 and non_null > 1)'
CHECKED = f"non_null > 0 and not {CONSTANT}"
NUMERIC = "kind in ('integral', 'fractional')"
NAMED = {
    "identifier": '"column" in (\'customer_id\', \'email\', \'order_id\')',
    "email": "\"column\" = 'email'",
    "percent": "\"column\" in ('discount_rate', 'error_rate', 'discount_pct')",
    "non_negative": "\"column\" in ('age', 'quantity')",
    "phone": "\"column\" in ('phone_number', 'mobile')",
    "dated": "\"column\" in ('signup_date', 'order_date', 'delivery_time', 'updated_at')",
    "date": "\"column\" in ('signup_date', 'order_date', 'updated_at')",
}
LIMIT = "case when len_sd > 0 then greatest(500, floor(len_mean + 3 * len_sd)::bigint) else 500 end"


def rule(name, module, no, when, n, as_type=None, severity=None, **slots) -> str:
    level, method, description = k.ISSUES[name]
    slots = {"c": '"column"', "n": n, "p": pct(n)} | slots
    return (
        f"select dataset_id, {module} as module, ordinal as column_no, {no} as rule_no, "
        f"'{as_type or name}' as type, {severity or text(level)} as severity, \"column\", "
        f"({n})::bigint as affected_rows, {pct(n)} as percentage, "
        f"{fill(description, **slots)} as description, {fill(method, **slots)} as method "
        f"from f where rows > 0 and {when}"
    )


MISSING_RULES = [
    rule("empty_column", 0, 0, f"{MISSING} = rows", MISSING),
    rule(
        "high_missing_percentage", 0, 1, f"{MISSING} < rows and {SHARE} >= 50", MISSING
    ),
    rule(
        "elevated_missing_percentage", 0, 2,
        f"{MISSING} < rows and {SHARE} >= 20 and {SHARE} < 50", MISSING,
        as_type="high_missing_percentage",
    ),
    rule(
        "missing_values", 0, 3, f"{MISSING} < rows and {MISSING} > 0 and {SHARE} < 20", MISSING
    ),
]
ID_RULES = [
    rule("duplicate_identifier", 1, 4, f"{NAMED['identifier']} and repeated > 0", "repeated")
]
_SHOWN = "case when length(shown) > 40 then left(shown, 37) || '...' else shown end"
VALIDITY_RULES = {
    "constant": rule("constant_column", 2, 5, f"non_null > 0 and {CONSTANT}", "non_null", v=_SHOWN),
    "low_variance": rule(
        "low_variance_column", 2, 6,
        f"{CHECKED} and rows >= 20 and \"unique\" > 1 and {pct('top')} >= 99", "top",
    ),
    "email": rule(
        "invalid_email", 2, 7,
        f"{CHECKED} and ({NAMED['email']} or coalesce(at_sign::double / non_null > 0.4, false)) "
        "and non_null - email_ok > 0",
        "non_null - email_ok",
    ),
    "percentage": rule(
        "impossible_percentage", 2, 8,
        f"{CHECKED} and {NAMED['percent']} and {NUMERIC} and off_percent > 0", "off_percent",
    ),
    "negative": rule(
        "negative_value_violation", 2, 9,
        f"{CHECKED} and {NAMED['non_negative']} and negatives > 0", "negatives",
    ),
    "phone": rule(
        "malformed_phone", 2, 10,
        f"{CHECKED} and {NAMED['phone']} and non_null - phone_ok > 0", "non_null - phone_ok",
    ),
    "date": rule(
        "invalid_date", 2, 11,
        f"{CHECKED} and {NAMED['dated']} and kind = 'string' and non_null - stamps_ok > 0 and "
        f"(dates * 2 >= non_null or {NAMED['date']})",
        "non_null - stamps_ok",
    ),
}


def outlier_rule(columns: dict[str, str]) -> str:
    counted = " ".join(
        f"when '{c}' then (select count(*) from t where \"{c}\" < lower_ or \"{c}\" > upper_)"
        for c, kind in columns.items()
        if kind in (I, D)
    )
    n = "n_out"
    severity = f"case when {pct(n)} >= 10 then 'high' when {pct(n)} >= 3 then 'medium' else 'low' end"
    level, method, description = k.ISSUES["outliers"]
    slots = {"c": '"column"', "n": n, "p": pct(n), "lo": fixed("lower_", 2), "hi": fixed("upper_", 2)}
    return (
        "select dataset_id, 3 as module, ordinal as column_no, 12 as rule_no, 'outliers' as type, "
        f"{severity} as severity, \"column\", n_out::bigint as affected_rows, {pct(n)} as percentage, "
        f"{fill(description, **slots)} as description, {text(method)} as method from ("
        "select *, q25 - 1.5 * (q75 - q25) as lower_, q75 + 1.5 * (q75 - q25) as upper_, "
        f'case "column" {counted} end as n_out from (select *, q25 - 1.5 * (q75 - q25) as lower_, '
        "q75 + 1.5 * (q75 - q25) as upper_ from f) "
        "where rows >= 4 and non_null >= 4 and q75 > q25) where n_out > 0"
    )


def long_rule(columns: dict[str, str]) -> str:
    counted = " ".join(
        f"when '{c}' then (select count(*) from t where length(\"{c}\") >= lim)"
        for c, kind in columns.items()
        if kind == S
    )
    level, method, description = k.ISSUES["extremely_long_text"]
    slots = {"c": '"column"', "n": "n_long", "p": pct("n_long"), "t": "lim"}
    return (
        "select dataset_id, 4 as module, ordinal as column_no, 14 as rule_no, "
        f"'extremely_long_text' as type, 'medium' as severity, \"column\", n_long as affected_rows, "
        f"{pct('n_long')} as percentage, {fill(description, **slots)} as description, "
        f"{fill(method, **slots)} as method from (select *, case \"column\" {counted} end as n_long "
        f"from (select *, {LIMIT} as lim from f where kind = 'string' and non_null > 0)) where n_long > 0"
    )


NEAR_EMPTY = rule(
    "near_empty_text", 4, 13, "near_empty > 0 and len_mean > 3", "near_empty",
    severity=f"case when {pct('near_empty')} >= 5 then 'medium' else 'low' end",
)
REPEATED = rule("repeated_text_anomaly", 4, 15, "repetitive > 0", "repetitive")
SPACING = rule("whitespace_formatting_anomaly", 4, 16, "badly_spaced > 0", "badly_spaced")


def copies(columns: dict[str, str], dataset: str = "dirty_customer") -> str:
    """A CTE d with exact and normalised duplicate counts."""
    exact = ", ".join(f'"{c}"' for c in columns)
    loose = ", ".join(
        f'lower({strip(f"{chr(34)}{c}{chr(34)}")})' if kind == S else f'"{c}"'
        for c, kind in columns.items()
    )
    return (
        f"g1 as (select count(*) n from t group by {exact}), "
        f"g2 as (select count(*) n from t group by {loose}), "
        f"d as (select '{dataset}' dataset_id, (select sum(n)::bigint from g1) rows, "
        "(select coalesce(sum(n), 0)::bigint from g1 where n > 1) exact_affected, "
        "(select sum(n - 1)::bigint from g1) exact_extra, "
        "(select coalesce(sum(n), 0)::bigint from g2 where n > 1) loose_affected, "
        "(select sum(n - 1)::bigint from g2) loose_extra)"
    )


def copy_rules(which: tuple[str, ...] = ("exact", "loose")) -> list[str]:
    out = []
    for name, n, x, place, key in (
        ("duplicate_rows", "exact_affected", "exact_extra", -1, "exact"),
        (
            "normalized_duplicate_rows",
            "(loose_affected - exact_affected)",
            "(loose_extra - exact_extra)",
            99999,
            "loose",
        ),
    ):
        if key not in which:
            continue
        level, method, description = k.ISSUES[name]
        slots = {"n": n, "x": x, "p": pct(n), "c": "''"}
        out.append(
            f"select dataset_id, 1 as module, {place} as column_no, 0 as rule_no, '{name}' as type, "
            f"'{level}' as severity, null::varchar as \"column\", {n} as affected_rows, "
            f"{pct(n)} as percentage, {fill(description, **slots)} as description, "
            f"{text(method)} as method from d where rows > 1 and {x} > 0 and {n} > 0"
        )
    return out


ISSUE_COLUMNS = 'dataset_id, ordinal, type, severity, "column", affected_rows, percentage, description, method'


def numbered(rules: list[str]) -> str:
    return (
        "i as (select *, row_number() over (order by module, column_no, rule_no)::int as ordinal "
        f"from ({' union all '.join(rules)}))"
    )


def some_issues(head: str, columns: dict, rules: list[str], *names: str, dataset="dirty_customer"):
    return (
        f"{head}, {facts(columns, *names, dataset=dataset)}, {numbered(rules)} "
        f"select {ISSUE_COLUMNS} from i"
    )


def all_issues(head: str, columns: dict[str, str], dataset: str) -> str:
    """CTEs up to i, the complete numbered issue list, and z, the dimensions."""
    rules = [
        *MISSING_RULES, *copy_rules(), *ID_RULES, *VALIDITY_RULES.values(),
        outlier_rule(columns), NEAR_EMPTY, long_rule(columns), REPEATED, SPACING,
    ]
    names = tuple(STRING_FACTS) + tuple(NUMBER_FACTS) + tuple(COUNTS) + ("shown",)
    sums = " + ".join(f'count(*) - count("{c}")' for c in columns)
    width = len(columns)
    return (
        f"{head}, {facts(columns, *names, dataset=dataset)}, {copies(columns, dataset)}, "
        f"{numbered(rules)}, z as (select '{dataset}' dataset_id, count(*) row_count, "
        f"{width}::bigint column_count, count(*) * {width} total_cells, {sums} null_cells, "
        "'parquet' file_format from t)"
    )


CI = all_issues(C, CUSTOMER, "dirty_customer")
OI = all_issues(O, ORDER, "dirty_order")

# ---- score --------------------------------------------------------------------------

_P = "percentage::decimal(9,2)"


def _between(factor: float, low: float, high: float) -> str:
    return f"least({high}::decimal(20,6), greatest({low}::decimal(20,6), ({_P} * {factor}::decimal(9,4))::decimal(20,6)))"


def score_ctes(weights: dict = k.SCORE_WEIGHTS) -> str:
    """CTEs p (deductions), m (dimension scores) and w (one wide row)."""
    n = k.SCORE_NOTES
    rows = []
    null_pct = pct("null_cells", "total_cells")
    rows.append(
        "select dataset_id, 'completeness' dim, 0 pos, least(40, v)::decimal(20,6) pts, "
        + fill(n["null_cells"], n="null_cells", p="v", d=fixed("least(40, v)", 1))
        + f" note from (select *, {null_pct} v from z) where null_cells > 0"
    )

    def add(dim: str, when: str, pts: str, template: str, y: str = "type") -> None:
        note = fill(
            template, c='"column"', n="affected_rows", p="percentage", d=fixed("pts", 1), y=y
        )
        rows.append(
            f"select dataset_id, '{dim}' dim, ordinal pos, pts, {note} note "
            f"from (select *, ({pts})::decimal(20,6) pts from i where {when})"
        )

    add("completeness", "type = 'empty_column'", "15", n["empty_column"])
    add(
        "completeness",
        "type = 'high_missing_percentage'",
        "case when severity = 'high' then 8 else 4 end",
        n["high_missing_percentage"],
    )
    add(
        "validity",
        "type in ('invalid_email', 'impossible_percentage', 'negative_value_violation', "
        "'malformed_phone', 'invalid_date')",
        f"case when severity = 'high' then {_between(1, 5, 35)} else {_between(0.6, 5, 35)} end",
        n["validity"],
        "replace(type, '_', ' ')",
    )
    add("uniqueness", "type = 'duplicate_rows'", _between(1.5, 0, 60), n["duplicate_rows"])
    add(
        "uniqueness", "type = 'duplicate_identifier'", _between(1.2, 0, 40), n["duplicate_identifier"]
    )
    add(
        "uniqueness",
        "type = 'normalized_duplicate_rows'",
        _between(0.8, 0, 25),
        n["normalized_duplicate_rows"],
    )
    add("consistency", "type = 'constant_column'", "10", n["constant_column"])
    add("consistency", "type = 'low_variance_column'", "5", n["low_variance_column"])
    add("consistency", "type = 'outliers'", _between(0.5, 3, 20), n["outliers"])
    add(
        "consistency",
        "type in ('near_empty_text', 'extremely_long_text', 'repeated_text_anomaly', "
        "'whitespace_formatting_anomaly')",
        _between(0.3, 2, 15),
        n["text"],
    )
    perfect = " ".join(f"when '{d}' then {text(v)}" for d, v in k.SCORE_PERFECT.items())
    dims = ", ".join(f"('{d}')" for d in k.SCORE_WEIGHTS)
    total = " + ".join(f"{weights[d]}::decimal(9,4) * {d}" for d in k.SCORE_WEIGHTS)
    wide = ", ".join(
        f"max(score) filter (where dimension = '{d}') {d}, max(line) filter (where dimension = '{d}') {d}_line"
        for d in k.SCORE_WEIGHTS
    )
    line = (
        "case when notes <> '' then "
        + fill(k.SCORE_LINE, k="cap", s="score", notes="notes")
        + " else "
        + fill(k.SCORE_LINE_PERFECT, k="cap", s="score", notes=f"case dimension {perfect} end")
        + " end"
    )
    return (
        f"p as ({' union all '.join(rows)}), "
        "m as (select z.dataset_id, dimension, coalesce(sum(pts), 0)::double deducted, "
        "greatest(0, least(100, round_even((100 - coalesce(sum(pts), 0))::double, 0)))::int score, "
        "coalesce(string_agg(note, '; ' order by pos), '') notes "
        f"from z cross join (values {dims}) as v(dimension) left join p on dim = dimension group by all), "
        f"w as (select *, greatest(0, least(100, round_even(({total})::double, 0)))::int overall from "
        f"(select dataset_id, {wide} from (select *, {line} line from (select *, "
        "upper(left(dimension, 1)) || dimension[2:] cap from m)) group by dataset_id))"
    )


CS = f"{CI}, {score_ctes()}"
TOTAL_LINE = fill(k.SCORE_OVERALL_LINE, s="overall", wc="30", wv="30", wu="20", ws="20")


def tier(labels: tuple) -> str:
    a, b, c, d = map(text, labels)
    return f"case when overall >= 85 then {a} when overall >= 70 then {b} when overall >= 50 then {c} else {d} end"


# ---- profile ------------------------------------------------------------------------

TYPED = """
y as (select *, case
  when iso::double / non_null >= 0.8 then 'ISO 8601 (YYYY-MM-DD)'
  when delimited::double / non_null >= 0.8 then 'Delimited Date (MM/DD/YYYY or DD/MM/YYYY)'
  when named::double / non_null >= 0.8 then 'Named Month Date'
  when (iso + delimited + named)::double / non_null >= 0.7 then 'Standard Date' end fmt
 from f),
yy as (select *, kind = 'temporal' or coalesce(kind = 'string' and non_null > 0
  and short_numbers::double / non_null <= 0.3 and fmt is not null
  and dates::double / non_null >= 0.9 and dates = dates_in_range, false) is_date from y),
ty as (select *, case when is_date then 'datetime'
  when kind = 'boolean' or (words in (['false', 'true'], ['no', 'yes'], ['n', 'y'], ['f', 't'])
       ) then 'boolean'
  when kind in ('integral', 'fractional') then 'numeric'
  when non_null > 0 and ("unique" <= 20 or (non_null > 50 and "unique"::double / non_null <= 0.05))
    then 'categorical' else 'text' end inferred_type from yy)
"""
CONFIDENCE = f"case when is_date then {ratio('dates', 'greatest(non_null, 1)', 100)} end"


def typed(head: str, columns: dict, dataset: str) -> str:
    return f"{head}, {facts(columns, dataset=dataset)}, {TYPED}"


def top_values(columns: dict) -> str:
    """A CTE tv with ranked values of the columns that get a distribution."""
    parts = [
        f"select '{c}' \"column\", \"{c}\"::varchar as value, count(*) n from t "
        f'where "{c}" is not null group by "{c}"'
        for c in columns
    ]
    return (
        f"tv as (select v.\"column\", value, n, row_number() over (partition by v.\"column\" "
        f"order by n desc, value) rank, {pct('n', 'non_null')} percentage "
        f"from ({' union all '.join(parts)}) v join ty using (\"column\") "
        "where inferred_type in ('categorical', 'boolean') or \"unique\" between 1 and 25)"
    )


def profile_ctes(head: str, columns: dict, dataset: str) -> str:
    """CTEs up to pr, the flat profile."""
    number = "inferred_type = 'numeric' and non_null > 0"
    length = "inferred_type in ('text', 'categorical') and non_null > 0"
    stats = ", ".join(
        f"case when {number} then round({c}, 4) end {name}"
        for name, c in (
            ("min", "mn"), ("max", "mx"), ("mean", "mean"), ("median", "q50"), ("std", "sd"),
            ("q25", "q25"), ("q75", "q75"),
        )
    )
    return (
        f"{typed(head, columns, dataset)}, {top_values(columns)}, "
        "pr as (select dataset_id, ordinal, ty.\"column\" as name, inferred_type, "
        "non_null as non_null_count, rows - non_null as null_count, "
        f"{pct('rows - non_null')} as null_percentage, \"unique\" as unique_count, "
        f"{pct(chr(34) + 'unique' + chr(34))} as unique_percentage, "
        f"{stats}, "
        f"case when {length} then len_min end min_length, "
        f"case when {length} then len_max end max_length, "
        f"case when {length} then {ratio('len_sum::bigint', 'non_null', 100)} end avg_length, "
        f"{CONFIDENCE} date_confidence, case when is_date then fmt end date_format, "
        "case when is_date then earliest end earliest, case when is_date then latest end latest, "
        "tv.value top_value, tv.n top_count, tv.percentage top_percentage "
        'from ty left join tv on tv."column" = ty."column" and tv.rank = 1)'
    )


CP = profile_ctes(C, CUSTOMER, "dirty_customer")
OP = profile_ctes(O, ORDER, "dirty_order")


# ---- cleaning -----------------------------------------------------------------------

TEXTS = [c for c, kind in CUSTOMER.items() if kind == S]
ALL = ", ".join(CUSTOMER)
LOOSE = k.EMAIL_LOOSE
TOKENS = ", ".join(text(v) for v in k.PLACEHOLDERS)


def lowered(c: str) -> str:
    return f"case when {matches(strip(c), LOOSE)} then lower({strip(c)}) else {c} end"


def nulled(c: str) -> str:
    return f"case when lower({strip(c)}) not in ({TOKENS}) then {c} end"


def collapsed(c: str) -> str:
    return f"regexp_replace({c}, '[ \\t]{{2,}}', ' ', 'g')"


def step(n: int, c: str) -> str:
    source = f"s{n - 1}_{c}"
    return {
        1: strip(source),
        2: collapsed(source),
        3: lowered(source) if c == "email" else source,
        4: nulled(source),
    }[n]


FIRST = (
    f"dd as (select * exclude (rn) from (select *, row_number() over (partition by {ALL} "
    "order by row_id) rn from t) where rn = 1)"
)
STAGES = (
    f"{FIRST}, st0 as (select *, {', '.join(f'{c} as s0_{c}' for c in TEXTS)} from dd), "
    + ", ".join(
        f"st{n} as (select *, {', '.join(f'{step(n, c)} as s{n}_{c}' for c in TEXTS)} from st{n - 1})"
        for n in range(1, 5)
    )
)
CLEANED = ", ".join(f"s4_{c} as {c}" if c in TEXTS else c for c in CUSTOMER)
CC = f"{C}, {STAGES}, cl as (select row_id, {CLEANED} from st4)"


def _audit() -> str:
    slots = {"k": "len(cols)", "names": "array_to_string(cols, ', ')"}
    names = list(k.CLEANING_STEPS)
    parts = [
        "select 1 step, 'remove_duplicates' type, n affected_rows, 0::bigint cells_modified, "
        "null::varchar[] cols from (select (select count(*) from t) - (select count(*) from dd) n)"
    ]
    for n in range(1, 5):
        changed = [f"s{n - 1}_{c} is distinct from s{n}_{c}" for c in TEXTS]
        cells = ", ".join(f"count(*) filter (where {x}) c{i}" for i, x in enumerate(changed))
        total = " + ".join(f"c{i}" for i in range(len(changed)))
        listed = ", ".join(f"case when c{i} > 0 then '{c}' end" for i, c in enumerate(TEXTS))
        parts.append(
            f"select {n + 1}, '{names[n]}', hit, {total}, "
            f"list_filter([{listed}], lambda x: x is not null) from "
            f"(select count(*) filter (where {' or '.join(changed)}) hit, {cells} from st4)"
        )
    description = " ".join(
        f"when '{t}' then " + fill(v, n="case when step = 1 then affected_rows else cells_modified end", **slots)
        for t, v in k.CLEANING_STEPS.items()
    )
    return (
        f"au as (select 'dirty_customer' dataset_id, step, type, case type {description} end description, "
        "affected_rows, cells_modified, array_to_string(cols, ', ') affected_columns "
        f"from ({' union all '.join(parts)}) where affected_rows > 0)"
    )


AUDIT = f"{CC}, {_audit()}"


def warn_outliers() -> str:
    parts = []
    for c in ("customer_id", "age", "total_spend", "discount_rate"):
        parts.append(
            f"select '{c}' \"column\", lo, hi, (select count(*) from dd where {c} < lo or {c} > hi) n, q3 - q1 iqr "
            f"from (select q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi, q1, q3 from (select "
            f"quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3 from dd))"
        )
    message = fill(
        k.CLEANING_WARNINGS["outliers"], n="n", c='"column"', lo=fixed("lo", 1), hi=fixed("hi", 1)
    )
    return (
        f"{CC} select 'outliers' kind, \"column\", n affected_rows, {message} as warning "
        f"from ({' union all '.join(parts)}) where n > 0 and iqr > 0"
    )


def warn_first(kind: str, columns: tuple, condition: str) -> str:
    message = fill(k.CLEANING_WARNINGS[kind], n="n", c='"column"', v="v")
    parts = [
        f"select '{c}' \"column\", count(*) n, arg_min({c}::varchar, row_id) v from cl where {condition.format(c=c)}"
        for c in columns
    ]
    return (
        f"{CC} select '{kind}' kind, \"column\", n affected_rows, {message} as warning "
        f"from ({' union all '.join(parts)}) where n > 0"
    )


def warn_nulls() -> str:
    message = fill(
        k.CLEANING_WARNINGS["mostly_null"], c='"column"', n="n", r="r", p=fixed("100 * n / r", 1)
    )
    parts = [f"select '{c}' \"column\", count(*) - count({c}) n, count(*) r from cl" for c in CUSTOMER]
    return (
        f"{CC} select 'mostly_null' kind, \"column\", n affected_rows, {message} as warning "
        f"from ({' union all '.join(parts)}) where 100 * n > 60 * r"
    )


# ---- privacy ------------------------------------------------------------------------


def redact(c: str, *kinds: str) -> str:
    for pattern, mask in {
        "email": (k.PII_EMAIL, k.MASK_EMAIL),
        "ssn": (k.PII_SSN, k.MASK_SSN),
        "card": (k.PII_CARD, k.MASK_CARD),
        "phone": (k.PII_PHONE, k.MASK_PHONE),
    }.items():
        if not kinds or pattern in kinds:
            c = f"regexp_replace({c}, {text(mask[0])}, {text(mask[1])}, 'g')"
    return c


def redacted_documents(*kinds: str) -> str:
    return f"select doc_id, {redact('text', *kinds)} as text from documents"


# ---- insights -----------------------------------------------------------------------


def weak(limit: int, default: str) -> str:
    named = ", ".join(f"case when {d} < {limit} then '{d}' end" for d in k.SCORE_WEIGHTS)
    return f"coalesce(nullif(concat_ws(', ', {named}), ''), {text(default)})"


def thousands(x: str) -> str:
    return f"format('{{:,}}', ({x})::bigint)"


SUMMARY_SLOTS = {
    "f": "'PARQUET'", "s": "overall", "r": thousands("row_count"), "k": "column_count",
    "completeness": "completeness", "validity": "validity",
}
SUMMARY = (
    f"case when overall >= 85 then {fill(k.SUMMARY_STRONG, **SUMMARY_SLOTS)} "
    f"when overall >= 60 then {fill(k.SUMMARY_MODERATE, **SUMMARY_SLOTS, dims=weak(75, k.SUMMARY_MODERATE_DEFAULT))} "
    f"else {fill(k.SUMMARY_CRITICAL, **SUMMARY_SLOTS, dims=weak(60, k.SUMMARY_CRITICAL_DEFAULT))} end"
)


def titled(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


def priorities(limit: int) -> str:
    slots = {
        "c": "coalesce(\"column\", 'Dataset-wide')", "n": thousands("affected_rows"),
        "p": "percentage", "r": thousands("row_count"), "title": titled("type"),
        "description": "description",
    }
    parts = []
    for j, name in enumerate(("issue", "importance", "explanation", "recommendation")):
        cases = " ".join(f"when '{t}' then {fill(v[j], **slots)}" for t, v in k.PRIORITY_TEXTS.items())
        parts.append(f"case type {cases} else {fill(k.PRIORITY_OTHER[j], **slots)} end as {name}")
    return (
        f"select dataset_id, rank, {', '.join(parts)} from (select i.*, row_count, row_number() over "
        "(order by case severity when 'high' then 0 else 1 end, ordinal) rank from i join z using (dataset_id) "
        f"where severity in ('high', 'medium')) where rank <= {limit}"
    )


PLAN = f"""
select dataset_id, row_number() over (order by pos)::int step,
 'Step ' || row_number() over (order by pos) || ': ' || action as action from (
 select 'dirty_customer' dataset_id, 1 pos, {fill(k.PLAN_EMPTY, names="(select string_agg(%scolumn%s, ', ' order by ordinal) from i where type = 'empty_column')" % (chr(34), chr(34)))} action
   where exists (select 1 from i where type = 'empty_column')
 union all select 'dirty_customer', 2, {text(k.PLAN_DUPLICATES)} where exists (select 1 from i where type = 'duplicate_rows')
 union all select 'dirty_customer', 3, {text(k.PLAN_RULES)} where exists (select 1 from i where type in ('invalid_email', 'impossible_percentage', 'negative_value_violation'))
 union all select 'dirty_customer', 4, {text(k.PLAN_MISSING)} where exists (select 1 from i where type in ('missing_values', 'high_missing_percentage'))
 union all select 'dirty_customer', 5, {text(k.PLAN_OUTLIERS)} where exists (select 1 from i where type = 'outliers'))
"""
IS_TEXT = "(contains(type, 'text') or contains(type, 'whitespace'))"
_NONE = "null::varchar"
CLIENT = f"""
select dataset_id, 'summary' part, 1 as position,
 {fill(k.CLIENT_SUMMARY, r=thousands("row_count"), k="column_count", s="overall", n="(select count(*) from i)")} headline,
 {_NONE} importance, {_NONE} detail, {_NONE} recommendation from w join z using (dataset_id)
union all select dataset_id, 'issue', ordinal, replace(type, '_', ' '),
 case when severity = 'high' then 'Critical' else 'Medium' end, description,
 {fill(k.CLIENT_RECOMMENDATION, n="affected_rows", c="coalesce(%scolumn%s, 'dataset')" % (chr(34), chr(34)))}
 from i where ordinal <= 3
""" + "".join(
    f" union all select 'dirty_customer', 'plan', {n}, {text(v)}, {_NONE}, {_NONE}, {_NONE}"
    for n, v in enumerate(k.CLIENT_PLAN, start=1)
)


def samples() -> str:
    parts = [
        f"select '{c}' \"column\", row_number() over (order by row_id)::int sample_no, "
        f"{redact(c)} as sample from t where {c} is not null qualify sample_no <= 2"
        for c in TEXTS
    ]
    return (
        f"{CI} select * from ({' union all '.join(f'({p})' for p in parts)}) where \"column\" in "
        f'(select "column" from i where {IS_TEXT})'
    )


# ---- report -------------------------------------------------------------------------


def sections(extra: str = "") -> str:
    return (
        f"{CI} select * from (select case when contains(type, 'duplicate') then 'duplicate' "
        "when contains(type, 'invalid') or contains(type, 'constant') or "
        f"contains(type, 'low_variance') or contains(type, 'negative') {extra} then 'validation' "
        "when contains(type, 'outlier') then 'outlier' end section, type, \"column\", "
        "affected_rows, percentage from i) where section is not null"
    )


_f = lambda c, d=1: fixed(c, d)
LINES = f"""
select dataset_id, ordinal, name,
 case when mean is not null then 'Min: ' || {_f("min")} || ' • Mean: ' || {_f("mean")} || ' • Max: ' || {_f("max")}
  when avg_length is not null then 'Len min: ' || min_length || ' • avg: ' || {_f("avg_length")} || ' • max: ' || max_length
  when top_value is not null then 'Top: ''' || top_value || ''' (' || {_f("top_percentage")} || '%)' else '—' end line,
 left(case when mean is not null then '[' || {_f("min")} || ', ' || {_f("max")} || '] μ=' || {_f("mean")}
  when avg_length is not null then 'len avg=' || {_f("avg_length")} || ' (max ' || max_length || ')'
  when top_value is not null then 'top: ''' || left(top_value, 10) || ''' (' || {_f("top_percentage", 0)} || '%)'
  else '—' end, 32) short_line from pr
"""
TOP_VALIDATION = f"""
select dataset_id, row_number() over (order by ordinal)::int as position, upper(severity) severity,
 left({titled("type")}, 18) issue, left(coalesce("column", 'Dataset'), 14) "column",
 {thousands("affected_rows")} as rows, left(description, 60) explanation
from i where contains(type, 'invalid') or contains(type, 'constant') or contains(type, 'low_variance')
 or contains(type, 'negative') qualify position <= 8
"""

# ---- sources and intake -------------------------------------------------------------

NULL_TOKENS = ", ".join(text(v) for v in k.CSV_NULL_TOKENS)


def csv_cells(columns: tuple[str, ...]) -> str:
    return ", ".join(f"case when {c} not in ({NULL_TOKENS}) then {c} end {c}" for c in columns)


def csv_back(columns: dict, source: str) -> str:
    """A table after a CSV round trip: null tokens are nulls, all-null columns are numeric."""
    cells = ", ".join(
        "null::double notes" if c == "notes" else csv_cells((c,)) if kind == S else c
        for c, kind in columns.items()
    )
    return f"select row_id, {cells} from {source}"


_NAME = "regexp_extract(regexp_replace({c}, '(?:/\\.?)+$', ''), '([^/]*)$', 1)"


def extension(c: str) -> str:
    return f"lower(regexp_extract({_NAME.format(c=c)}, '^.+(\\.[^.]+)$', 1))"


def sanitized(c: str) -> str:
    name = _NAME.format(c=c)
    stem = f"case when {extension(c)} <> '' then regexp_replace({name}, '\\.[^.]+$', '') else {name} end"
    safe = f"trim(regexp_replace({stem}, '[^a-zA-Z0-9_\\-]', '_', 'g'), '._')"
    return (
        f"coalesce(nullif({safe}, ''), 'dataset') || "
        f"regexp_replace({extension(c)}, '[^a-zA-Z0-9.]', '', 'g')"
    )


_BLOCKED = " or ".join(f"starts_with(mime, '{p}')" for p in k.BLOCKED_MIME_PREFIXES)
_WORDS = lambda v: ", ".join(text(x) for x in v)
MIME = f"""
with m as (select page_id, url || case page_id % 3 when 0 then '.csv' when 1 then '.JSON' else '.txt' end filename,
  [{_WORDS(CONTENT_TYPES)}][page_id % 5 + 1] ct, length(html) * (page_id % 4) * 40000 size from pages),
 e as (select *, {extension("filename")} ext, trim(string_split(lower(ct), ';')[1]) mime from m)
select page_id, size::bigint size, case
  when ext not in ('.csv', '.json') then 'unsupported extension'
  when ct <> '' and ({_BLOCKED}) then 'disallowed MIME type'
  when ct <> '' and ext = '.csv' and mime not in ({_WORDS(k.CSV_MIMES)}) then 'MIME type not valid for CSV'
  when ct <> '' and ext = '.json' and mime not in ({_WORDS(k.JSON_MIMES)}) then 'MIME type not valid for JSON'
  when size = 0 then 'empty file' when size > {k.MAX_FILE_BYTES} then 'file too large'
  else 'accepted' end verdict from e
"""
SORTED_BY = {
    "severity": "case severity when 'high' then 3 when 'medium' then 2 else 1 end",
    "affected_rows": "affected_rows",
    "percentage": "percentage",
    "column": "coalesce(\"column\", '')",
    "issue": "type",
}
SUPPLIER_FOLDER = """
select * replace (case when s_suppkey % 2 = 1 then s_acctbal end as s_acctbal) from supplier
"""
# one event of each key after the other, with the accepted times still in its window
RATE_LIMIT = """
with recursive e as materialized (
  select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (
  select event_id, user_id, rn, [ts] as kept, true as accepted from e where rn = 1
  union all
  select event_id, user_id, rn, case when len(near) < 3 then list_append(near, ts) else near end, len(near) < 3
  from (select e.*, list_filter(r.kept, lambda x: e.ts - x <= interval 1 day) as near
    from r join e on e.user_id is not distinct from r.user_id and e.rn = r.rn + 1))
select event_id, user_id, accepted from r
"""
INTAKE_AUDIT = """
select * from (values ('csv', 'accepted', true, 0::bigint), ('json', 'accepted', true, 0),
  ('txt', 'unsupported extension', true, 0)) t(format, verdict, files, bad_lines)
"""
INTAKE_CONTENT = """
with t as (
  select 'd' || doc_id || case doc_id % 2 when 0 then '.csv' else '.JSON' end filename,
    case doc_id % 5 when 0 then '' when 1 then ' ' || chr(10) || ' ' else text end as body from documents
  union all
  select 'e' || event_id || '.json', case event_id % 3 when 0 then left(props, length(props) - 1)
    when 1 then props || chr(10) || props else props end from events),
 l as (select *, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') as parts from t)
select filename, case when body = '' then 'empty file'
  when lower(filename) like '%.csv' then case when len(parts) = 0 then 'blank CSV' else 'accepted' end
  when json_valid(body) or (len(parts) > 0 and len(list_filter(parts, lambda x: not json_valid(x))) = 0) then 'accepted'
  else 'invalid JSON' end as verdict from l
"""
CUTOFF = f"timestamp '{AS_OF}' - interval 24 hour"

# ---- registry -----------------------------------------------------------------------


def numeric_stats(head: str, columns: dict, dataset: str) -> str:
    stats = ("mn", "mx", "mean", "sd", "q25", "q50", "q75")
    rounded = ", ".join(f"round({s}, 4) as {s}" for s in stats)
    return f'{head}, {facts(columns, *stats, dataset=dataset)} select "column", {rounded} from f where mn is not null'


def lengths(head: str, columns: dict) -> str:
    return (
        f"{head}, {facts(columns, 'len_min', 'len_max', 'len_sum')} select \"column\", "
        f"len_min as min_length, len_max as max_length, "
        f"{ratio('len_sum::bigint', 'non_null', 100)} as avg_length from f "
        "where kind = 'string' and non_null > 0"
    )


def dimension(name: str) -> str:
    return f"{CS} select dimension, deducted, score, notes from m where dimension = '{name}'"


def physical() -> str:
    parts = []
    for i, c in enumerate(ORDER):
        parts.append(
            f"select {i} ordinal, '{c}' \"column\", count(v) filled, "
            "count(*) filter (where regexp_full_match(v, '\\s*[+-]?\\d+\\s*') and try_cast(v as bigint) is not null) ints, "
            "count(*) filter (where regexp_full_match(v, '\\s*[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?)\\s*')) nums, "
            "count(*) filter (where lower(v) in ('true', 'false')) bools "
            f'from (select "{c}"::varchar v from t)'
        )
    return (
        f"{O} select \"column\", filled, case when filled = 0 then 'double' when ints = filled then 'bigint' "
        "when nums = filled then 'double' when bools = filled then 'boolean' else 'string' end physical_type "
        f"from ({' union all '.join(parts)})"
    )


def customer_bytes() -> str:
    """Bytes of the dirty customers, as document_bytes has it for documents."""
    sizes = " + ".join(
        f"coalesce(sum(strlen({c})), 0)" if kind == S else f"8 * count({c})"
        for c, kind in CUSTOMER.items()
    )
    return (
        f"select case when b < 1024 then b || ' B' when b < 1048576 then {fixed('b / 1024', 1)} || ' KB' "
        f"else {fixed('b / 1048576', 2)} || ' MB' end size from (select {sizes} b from t)"
    )


SECTIONS = (
    "Dataset Overview", "Overall Quality Score", "Dimension Scores", "Column Profile",
    "Missing-Value Analysis", "Duplicate Analysis", "Validation Problems", "Outliers",
    "Text-Quality Findings", "Executive Summary", "Priority Recommendations",
    "Cleaning Summary",
)


def whole_report() -> str:
    """The twelve sections from the SQL of their parts, by the tables that they share."""

    def tail(name: str, head: str) -> str:
        return f"({EXPECTED[name].removeprefix(head)})"

    duplicate, outlier = "contains(type, 'duplicate')", "contains(type, 'outlier')"
    invalid = "(" + " or ".join(f"contains(type, '{x}')" for x in ("invalid", "constant", "low_variance", "negative")) + ")"
    titled_issue = "type || coalesce(': ' || \"column\", '')"
    from_issues = [
        (1, f"select 1, 'Total Rows', {thousands('row_count')} from z"),
        (1, "select 2, 'Total Columns', column_count::varchar from z"),
        (1, f"select 3, 'Memory Footprint', size from ({customer_bytes()})"),
        (1, "select 4, 'Format', 'PARQUET'"),
        (2, f"select 0, report_tier, overall::varchar from {tail('score_tier', CS)}"),
        (2, f"select position + 1, 'explanation', line from {tail('score_explanations', CS)}"),
        (6, f"select 1, 'duplicates', arg_min(description, ordinal) from i where {duplicate} having count(*) > 0"),
        (7, f"select ordinal, {titled_issue}, description from i where not {duplicate} and {invalid}"),
        (8, f"select ordinal, {titled_issue}, description from i where not {duplicate} and not {invalid} and {outlier}"),
        (9, f"select 1000 + position, 'observation', observation from {tail('insight_text', CI)}"),
        (10, f"select 1, 'summary', summary from {tail('insight_summary', CS)}"),
        (11, f"select rank, issue, recommendation from {tail('insight_priority', CI)}"),
        (11, f"select 100 + step, 'plan', action from {tail('insight_plan', CI)}"),
    ]
    for n, d in enumerate(("completeness", "validity", "uniqueness", "consistency"), start=1):
        from_issues.append((3, f"select {n}, '{d.title()}', {d}::varchar from w"))
    missing = tail("report_missing", CP)
    from_profile = [
        (4, f"select ordinal, name, line from {tail('report_column_lines', CP)}"),
        (5, f"select 1, 'Total Missing Cells', {thousands('total_missing')} from {missing}"),
        (5, f"select 2, 'Missing Share', {fixed('missing_pct', 2)} || '%' from {missing}"),
        (5, f"select 3, 'Columns with Missing Data', columns_with_nulls || ' of ' || column_count from {missing}"),
        (9, f"select ordinal, name, 'min len ' || min_length || ', avg len ' || {fixed('avg_length', 1)} || ', max len ' || max_length "
            f"from {tail('report_text_columns', CP)} where avg_length is not null"),
    ]
    from_audit = [(12, f"select step, type, description from {tail('report_cleaning', AUDIT)}")]
    for n, c in enumerate(("original_rows", "cleaned_rows", "rows_removed", "cells_modified")):
        from_audit.append((12, f"select {100 + n}, '{c}', {thousands(c)} from {tail('clean_summary', AUDIT)}"))

    def united(head: str, parts: list[tuple[int, str]]) -> str:
        rows = " union all ".join(
            f"select {no} no, position::int position, key::varchar as key, value::varchar as value from ({part}) p(position, key, value)"
            for no, part in parts
        )
        return f"select * from ({head} {rows})"

    titles = ", ".join(f"({no}, {text(title)})" for no, title in enumerate(SECTIONS, start=1))
    rows = " union all ".join([united(CS, from_issues), united(CP, from_profile), united(AUDIT, from_audit)])
    return (
        "select 'dirty_customer' dataset_id, no section_no, title section, position, key, value "
        f"from ({rows}) join (values {titles}) s(no, title) using (no)"
    )


def document_bytes() -> str:
    size = "sum(coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) + 8 * count(doc_id) + 8 * count(n_chars)"
    return (
        f"select 'documents' dataset_id, b::bigint bytes, case when b < 1024 then b || ' B' "
        f"when b < 1048576 then {fixed('b / 1024', 1)} || ' KB' else {fixed('b / 1048576', 2)} || ' MB' end size "
        f"from (select {size} b from documents)"
    )


SCORE_COLUMNS = "dataset_id, overall, completeness, validity, uniqueness, consistency"

EXPECTED: dict[str, str] = {
    "profile_dims": "select 'lineitem' dataset_id, count(*) row_count, 11::bigint column_count, "
    "count(*) * 11 total_cells, "
    + " + ".join(f"count(*) - count({c})" for c in LINEITEM)
    + " null_cells, 'parquet' file_format from lineitem",
    "profile_bytes": document_bytes(),
    "profile_nulls": f"{C}, {facts(CUSTOMER, 'blank')} select \"column\", non_null non_null_count, "
    f"rows - non_null null_count, {pct('rows - non_null')} null_percentage from f",
    "profile_distinct": f"{L}, {facts(LINEITEM, 'unique')} select \"column\", \"unique\" unique_count, "
    f"{pct(chr(34) + 'unique' + chr(34))} unique_percentage from f",
    "profile_numeric": numeric_stats(L, LINEITEM, "lineitem"),
    "profile_numeric_dirty": numeric_stats(C, CUSTOMER, "dirty_customer"),
    "quartiles_bracketed": f"{L}, {facts({c: LINEITEM[c] for c in ('l_extendedprice', 'l_partkey', 'l_tax')}, 'q25', 'q50', 'q75')} "
    'select "column", round(q25, 4) q25, round(q50, 4) q50, round(q75, 4) q75 from f',
    "profile_text_length": lengths(DOC, DOCUMENTS),
    "profile_text_length_dirty": lengths(C, CUSTOMER),
    "profile_top_values": f"{typed(L, LINEITEM, 'lineitem')}, {top_values(LINEITEM)} "
    'select "column", rank, value, n as count, percentage from tv where rank <= 10',
    "profile_top_values_dirty": f"{typed(O, ORDER, 'dirty_order')}, {top_values(ORDER)} "
    'select "column", rank, value, n as count, percentage from tv where rank <= 10',
    "profile_dates": f"{typed(O, ORDER, 'dirty_order')} select \"column\", {CONFIDENCE} date_confidence, "
    "fmt date_format, earliest date_earliest, latest date_latest from ty where is_date",
    "profile_full": f"{CP} select * from pr",
    "profile_full_orders": f"{OP} select * from pr",
    "infer_physical": physical(),
    "infer_dates": f"{typed(C, CUSTOMER, 'dirty_customer')} select \"column\", is_date, {CONFIDENCE} date_confidence, "
    "case when is_date then fmt end date_format, case when is_date then earliest end date_earliest, "
    "case when is_date then latest end date_latest from ty",
    "infer_logical": f"{typed(O, ORDER, 'dirty_order')} select \"column\", inferred_type from ty",
    "infer_logical_customer": f"{typed(C, CUSTOMER, 'dirty_customer')} select \"column\", inferred_type from ty",
    "email_candidates": f"{O}, {facts(ORDER, 'at_sign')} select \"column\", "
    "coalesce(kind = 'string' and at_sign::double / nullif(non_null, 0) > 0.4, false) email_candidate from f",
    "issues_missing": some_issues(C, CUSTOMER, MISSING_RULES, "blank"),
    "issues_dup_rows": f"{C}, {copies(CUSTOMER)}, {numbered(copy_rules(('exact',)))} select {ISSUE_COLUMNS} from i",
    "issues_dup_normalized": f"{C}, {copies(CUSTOMER)}, {numbered(copy_rules(('loose',)))} select {ISSUE_COLUMNS} from i",
    "duplicate_counts_lineitem": f"{L}, {copies(LINEITEM, 'lineitem')} select * from d",
    "issues_dup_ids": some_issues(C, CUSTOMER, ID_RULES, "repeated"),
    "issues_constant": some_issues(C, CUSTOMER, [VALIDITY_RULES["constant"]], "unique", "shown"),
    "issues_low_variance": some_issues(C, CUSTOMER, [VALIDITY_RULES["low_variance"]], "unique", "top"),
    "issues_email": some_issues(C, CUSTOMER, [VALIDITY_RULES["email"]], "unique", "at_sign", "email_ok"),
    "issues_email_candidate": some_issues(
        O, ORDER, [VALIDITY_RULES["email"]], "unique", "at_sign", "email_ok", dataset="dirty_order"
    ),
    "issues_percentage": some_issues(C, CUSTOMER, [VALIDITY_RULES["percentage"]], "unique", "off_percent"),
    "issues_negative": some_issues(C, CUSTOMER, [VALIDITY_RULES["negative"]], "unique", "negatives"),
    "issues_phone": some_issues(C, CUSTOMER, [VALIDITY_RULES["phone"]], "unique", "phone_ok"),
    "issues_date": some_issues(
        O, ORDER, [VALIDITY_RULES["date"]], "unique", "stamps_ok", "dates", dataset="dirty_order"
    ),
    "outlier_fences": f"{L}, {facts(LINEITEM, 'q25', 'q75')} select 'lineitem' dataset_id, \"column\", "
    "round(q25, 4) q25, round(q75, 4) q75, round(q75 - q25, 4) iqr, "
    "round(q25 - 1.5 * (q75 - q25), 4) lower_bound, round(q75 + 1.5 * (q75 - q25), 4) upper_bound "
    "from f where rows >= 4 and non_null >= 4 and q75 > q25",
    "issues_outliers": some_issues(C, CUSTOMER, [outlier_rule(CUSTOMER)], "q25", "q75"),
    "issues_outliers_events": some_issues(
        EV, EVENTS, [outlier_rule(EVENTS)], "q25", "q75", dataset="events"
    ),
    "issues_near_empty": some_issues(C, CUSTOMER, [NEAR_EMPTY], "near_empty", "len_mean"),
    "issues_long_text": some_issues(
        DOC, DOCUMENTS, [long_rule(DOCUMENTS)], "len_mean", "len_sd", dataset="documents"
    ),
    "issues_repeated_text": some_issues(DOC, DOCUMENTS, [REPEATED], "repetitive", dataset="documents"),
    "issues_whitespace": some_issues(DOC, DOCUMENTS, [SPACING], "badly_spaced", dataset="documents"),
    "issues_all": f"{CI} select {ISSUE_COLUMNS} from i",
    "issues_all_orders": f"{OI} select {ISSUE_COLUMNS} from i",
    "issues_by_severity": f"{CI} select 'dirty_customer' dataset_id, s severity, "
    "(select count(*) from i where severity = s) issues from (values ('high'), ('medium'), ('low')) v(s)",
    "issues_filter": f"{CI} select {ISSUE_COLUMNS} from i where severity = 'high' and contains("
    "lower(concat_ws(chr(1), \"column\", type, description, method)), 'email')",
    "issues_filter_search": f"{CI} select {ISSUE_COLUMNS} from i where contains("
    "lower(concat_ws(chr(1), \"column\", type, description, method)), 'email')",
    "issues_filter_severity": f"{CI} select {ISSUE_COLUMNS} from i where severity = 'medium'",
    **{
        f"issues_sorted_{key}_{name}": f"{CI} select row_number() over (order by {by} {way}, ordinal)::int "
        'as position, type, severity, "column", affected_rows from i'
        for key, by in SORTED_BY.items()
        for name, way in (("down", "desc"), ("up", "asc"))
    },
    "issues_sorted": f"{CI} select row_number() over (order by case severity when 'high' then 3 "
    "when 'medium' then 2 else 1 end desc, ordinal)::int as position, type, severity, \"column\", "
    "affected_rows from i",
    "score_completeness": dimension("completeness"),
    "score_validity": dimension("validity"),
    "score_uniqueness": dimension("uniqueness"),
    "score_consistency": dimension("consistency"),
    "score_overall": f"{CS} select {SCORE_COLUMNS} from w",
    "score_overall_orders": f"{OI}, {score_ctes()} select {SCORE_COLUMNS} from w",
    "score_weighted": f"{CI}, {score_ctes(dict(completeness=0.1, validity=0.2, uniqueness=0.3, consistency=0.4))} "
    f"select {SCORE_COLUMNS} from w",
    "score_explanations": f"{CS} select dataset_id, 0 as position, {TOTAL_LINE} as line from w "
    + " ".join(
        f"union all select dataset_id, {n}, {d}_line from w"
        for n, d in enumerate(k.SCORE_WEIGHTS, start=1)
    ),
    "score_tier": f"{CS} select dataset_id, overall, {tier(k.REPORT_TIERS)} report_tier, "
    f"{tier(k.DASHBOARD_TIERS)} dashboard_tier from w",
    "score_bands": f"{CS} select dataset_id, dimension, score, case when score >= 85 then 'excellent' "
    "when score >= 70 then 'good' when score >= 50 then 'fair' else 'critical' end band, "
    "greatest(0, 85 - score) below_target from m",
    "clean_dedup_batches": f"{C}, {FIRST} select * from dd",
    "duplicate_counts_batches": f"{C}, {copies(CUSTOMER)} select rows, exact_affected, exact_extra from d",
    "profile_distinct_merged": f"{L}, {facts(LINEITEM, 'unique')} select \"column\", rows, non_null, "
    "\"unique\" unique_count, true within_bounds from f",
    "clean_dedup": f"{C}, {FIRST} select * from dd",
    "clean_trim": f"{C} select row_id, "
    + ", ".join(f"{strip(c)} as {c}" for c in ("customer_name", "comment", "mixed"))
    + " from t",
    "clean_collapse": f"{C} select row_id, {collapsed('comment')} as comment from t",
    "clean_email": f"{C} select row_id, {lowered('email')} as email from t",
    "clean_nulls": f"{C} select row_id, "
    + ", ".join(f"{nulled(c)} as {c}" for c in ("comment", "mixed", "email"))
    + " from t",
    "clean_full": f"{CC} select * from cl",
    "clean_audit": f"{AUDIT} select * from au",
    "clean_summary": f"{AUDIT} select 'dirty_customer' dataset_id, (select count(*) from t) original_rows, "
    "(select count(*) from dd) cleaned_rows, (select count(*) from t) - (select count(*) from dd) rows_removed, "
    "(select sum(cells_modified)::bigint from au) cells_modified",
    "clean_warn_outliers": warn_outliers(),
    "clean_warn_negatives": warn_first("negatives", ("age", "total_spend", "discount_rate"), "{c} < 0"),
    "clean_warn_email": warn_first(
        "malformed_email", ("email",), "{c} is not null and not " + matches("email", LOOSE)
    ),
    "clean_warn_nulls": warn_nulls(),
    "redact_email": redacted_documents("email"),
    "redact_ssn": redacted_documents("ssn"),
    "redact_card": redacted_documents("card"),
    "redact_phone": redacted_documents("phone"),
    "redact_text": redacted_documents(),
    "redact_table": f"select conv_id, turn, {redact('role')} as role, {redact('text')} as text from conversations",
    "mask_sensitive": f"{C} select row_id, case when mostly_null is not null then '{k.MASK_SECRET}' end api_key_hint, "
    f"'{k.MASK_SECRET}' token_age from t",
    "redact_nested": f"{C} select row_id, {redact('email')} as email, '{k.MASK_SECRET}' as password, age from t",
    "summary_columns": f"{CP} select dataset_id, ordinal, name, inferred_type, null_percentage, unique_count, "
    "min, max, mean, median, min_length, max_length, avg_length from pr",
    "summary_issues": f"{CI} select {ISSUE_COLUMNS.replace(', method', '')} from i",
    "summary_samples": samples(),
    "insight_summary": f"{CS} select dataset_id, {SUMMARY} as summary from w join z using (dataset_id)",
    "insight_priority": f"{CI} {priorities(5)}",
    "insight_plan": f"{CI} {PLAN}",
    "insight_text": f"{CI} select dataset_id, row_number() over (order by ordinal)::int as position, "
    "'Column ''' || \"column\" || ''': ' || description as observation "
    f"from i where {IS_TEXT} qualify position <= 3",
    "insight_client": f"{CS} {CLIENT}",
    "report_missing": f"{CP} select dataset_id, sum(null_count)::bigint total_missing, "
    "sum(null_count + non_null_count)::bigint total_cells, "
    f"{pct('sum(null_count)::bigint', 'sum(null_count + non_null_count)::bigint')} missing_pct, "
    "count(*) filter (where null_count > 0) columns_with_nulls, count(*) column_count from pr group by dataset_id",
    "report_sections": sections(),
    "report_sections_complete": sections("or contains(type, 'impossible') or contains(type, 'malformed')"),
    "report_text_columns": f"{CP} select dataset_id, ordinal, name, inferred_type, min_length, max_length, avg_length "
    "from pr where inferred_type = 'text' or avg_length is not null",
    "report_column_lines": f"{CP} {LINES}",
    "report_top_validation": f"{CI} {TOP_VALIDATION}",
    "report_recommendations": f"{CI} {priorities(4)}",
    "report_cleaning": f"{AUDIT} select dataset_id, 'executed' status, step, type, description, affected_rows, cells_modified from au",
    "overview_kpis": f"{CI} select dataset_id, (select count(*) from i) total_issues, "
    "(select count(*) from i where severity = 'high') high_issues, null_cells total_missing, "
    "(select coalesce(max(affected_rows), 0) from i where type = 'duplicate_rows') duplicate_rows, "
    "a::bigint affected_rows, "
    + ratio("100 * a", "row_count", 10)
    + " affected_percentage from (select *, least((select sum(affected_rows) from i)::bigint, row_count) a from z)",
    "top_null_columns": f"{CP} select dataset_id, row_number() over (order by null_percentage desc, ordinal)::int as position, "
    "name, null_count, null_percentage, case when null_percentage > 20 then 'high' when null_percentage > 5 then 'medium' "
    "when null_percentage > 0 then 'low' else 'none' end band from pr qualify position <= 8",
    "type_distribution": f"{CP} select dataset_id, inferred_type, count(*) columns, "
    "floor(100.0 * count(*) / (select count(*) from pr) + 0.5)::bigint percentage from pr group by all",
    "severity_distribution": f"{CI} select 'dirty_customer' dataset_id, label, "
    "(select count(*) from i where severity = s) issues, "
    "floor(100.0 * (select count(*) from i where severity = s) / (select count(*) from i) + 0.5)::bigint percentage "
    "from (values ('high', 'High (Critical)'), ('medium', 'Medium (Warning)'), ('low', 'Low (Notice)')) v(s, label)",
    "scan_table": "select o_orderstatus, count(*) orders, min(o_totalprice) lowest from orders group by o_orderstatus",
    "scan_csv": f"{C} {csv_back(CUSTOMER, 't')}",
    "sink_csv": f"{CC} select * from cl",
    "sink_json": f"{CC} select * from cl",
    "scan_json_lines": "select event_id, event_type, value, (props->>'$.k')::bigint as \"props.k\" from events",
    "sink_audit": f"{AUDIT} select dataset_id, step, type, affected_rows, cells_modified from au",
    "json_flatten": "select event_id, (props->>'$.k')::bigint as \"props.k\" from events",
    "json_nested_text": "select event_id, '{\"ids\": [' || user_id || '], \"t\": \"' || event_type || '\", \"v\": ' || value || '}' cell from events",
    "preview": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders order by o_orderkey limit 5",
    "preview_shape": "select 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as columns, "
    "6::bigint column_count, count(*) row_count from orders",
    "sanitize_filename": f"select page_id, {sanitized('url')} as filename from pages",
    **{f"scan_json_{shape}": "select * from supplier" for shape in ("records", "wrapper", "record_map", "columns", "bom")},
    "scan_json_object": "select * from nation",
    "scan_json_scalars": "select s_acctbal as value from supplier",
    "scan_csv_cut": "select doc_id, '\"' || text || '\",' || chr(10) as text, lang from documents",
    "scan_json_cut": "select * from customer",
    "scan_csv_folder": SUPPLIER_FOLDER,
    "mime_rules": MIME,
    "rate_limit": RATE_LIMIT,
    "intake_audit": INTAKE_AUDIT,
    "intake_content": INTAKE_CONTENT,
    "retention": f"select event_id, user_id from events where ts >= {CUTOFF}",
    "retention_purged": f"select count(*) filter (where ts < {CUTOFF}) purged, count(*) filter (where ts >= {CUTOFF}) retained from events",
    "delete_dataset": "select event_id, 'dataset_' || event_type dataset_id from events where event_type <> 'click'",
    "delete_dataset_summary": "select count(*) filter (where event_type = 'click') deleted_rows, "
    "count(*) filter (where event_type = 'click') > 0 deleted from events",
    "window_counts": "select event_id, user_id, count(*) over (partition by user_id order by ts "
    "range between interval 1 day preceding and current row) window_count from events",
}

EXPECTED["report_full"] = whole_report()
