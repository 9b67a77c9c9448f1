"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust their score. SQL functions only.

Base kinds (always reported once their check holds): ``email``; ``ip`` (four
parts of at most 255); ``card`` (16 to 19 digits, Luhn); ``phone``
(international, 8 to 15 digits). Added kinds (reported from score
``MIN_SCORE`` on): ``iban`` (mod-97 confirms it) and ``ssn`` (needs a context
word nearby).

Positions come from cutting a text at the matches: a match starts where the
pieces and matches before it end. All patterns are possessive, so a run of
any length costs one pass and no stack.

Edge cases: a null text counts as empty (no spans); repeated rows each give
their own row; an empty table gives an empty result; further columns are
passed through by ``redact`` and not read by ``find_spans``. Texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 50
CONTEXT_CHARS = 40

#: A match starts at the start of a run, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A cheap test that holds for every text with a span of the kind.
GUARDS = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9 ]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
CONTEXT = {
    "email": r"[Mm]ail|[Cc]ontact",
    "ip": r"[Ss]erver|[Hh]ost|IP|[Aa]ddress",
    "card": r"[Cc]ard|[Vv]isa|[Mm]aster|[Cc]redit|[Kk]arte|[Tt]arjeta",
    "phone": r"[Pp]hone|[Tt]el|[Cc]all|[Ff]ax|[Mm]obil",
    "iban": r"IBAN|[Aa]ccount|[Bb]ank|[Kk]onto|[Cc]uenta|[Cc]ompte",
    "ssn": r"SSN|[Ss]ocial [Ss]ecurity|[Tt]ax",
}
#: Score of a pattern match, of a passed checksum, and of a context word.
PATTERN_SCORE = {"email": 80, "ip": 60, "card": 30, "phone": 50, "iban": 30, "ssn": 30}
CHECKSUM_SCORE, CONTEXT_SCORE = 40, 20

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<kind:string,start:int,end:int,value:string,score:int,context:boolean>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an IBAN by 97: first four characters last, A = 10, ..., Z = 35."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 1 << 20), F.substring(compact, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0),
                       lambda acc, c: F.pmod(acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c), F.lit(97)))


def _holds(kind: str, value: Column, before: Column, after: Column) -> Column:
    """Whether the kind's validator accepts a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    alone = ~before.rlike("[A-Za-z0-9-]$") & ~after.rlike("^[A-Za-z0-9-]")
    if kind == "iban":
        return alone & (mod97(value) == 1)
    return alone & ~value.rlike("^(?:000|666|9)|-00-|-0000$")


def _near(kind: str, before: Column, after: Column) -> Column:
    """Whether a context word of the kind stands close to a match."""
    return (F.right(before, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind])
            | F.left(after, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind]))


def _span_list(kind: str, matches: Column, pieces: Column) -> Column:
    """The accepted matches of one kind, in order."""
    def take(acc: Column, i: Column) -> Column:
        value, before, after = F.get(matches, i), F.get(pieces, i), F.get(pieces, i + 1)
        start = acc["at"] + F.length(before)
        end = start + F.length(value)
        near = _near(kind, before, after)
        checked = CHECKSUM_SCORE if kind in ("card", "iban") else 0
        score = F.lit(PATTERN_SCORE[kind] + checked) + F.when(near, CONTEXT_SCORE).otherwise(0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"),
                        score.alias("score"), near.alias("context"))
        keep = _holds(kind, value, before, after)
        if kind not in BASE_KINDS:
            keep = keep & (score >= MIN_SCORE)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(F.size(matches) == 0, none).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, take)["found"])


def _cut(kind: str, text: Column) -> tuple[Column, Column]:
    """Matches of a kind's pattern and the pieces around them (empty if the guard fails)."""
    some = text.rlike(GUARDS[kind])
    none = F.array().cast("array<string>")
    return (F.when(some, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none),
            F.when(some, F.split(text, PATTERNS[kind], -1)).otherwise(none))


def _with_spans(docs: DataFrame, text: Column, name: str, *own: Column | str) -> DataFrame:
    """``own`` columns of ``docs`` and the spans of ``text``."""
    cut = {k: _cut(k, text) for k in KINDS}
    parts = docs.select(*own, *[c.alias(f"__pii_{k}_{i}") for k in KINDS for i, c in enumerate(cut[k])])
    lists = [_span_list(k, F.col(f"__pii_{k}_0"), F.col(f"__pii_{k}_1")) for k in KINDS]
    return parts.withColumn(name, F.concat(*lists)).drop(*[f"__pii_{k}_{i}" for k in KINDS for i in (0, 1)])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans``: all spans of every row, by kind as in ``KINDS`` and
    then by start (code points, end exclusive), with value and score."""
    return _with_spans(docs, F.coalesce(F.col(text_col), F.lit("")), "spans", F.col(id_col).alias("id")).select(F.col("id").alias(id_col), "spans")


def _merged(spans: Column) -> Column:
    """Sorted spans with the overlapping ones joined; a joined span is of the kind of its longest member."""
    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        size = s["end"] - s["start"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                          F.when(size > last["size"], s["kind"]).otherwise(last["kind"]).alias("kind"), F.greatest(last["size"], size).alias("size"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), size.alias("size"))
        return (F.when((F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
                .otherwise(F.concat(acc, F.array(fresh))))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string,size:int>>"), add)


def _cut_once(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with all spans masked at once, for texts in which some overlap."""
    found, sorted_ = F.col("__pii_spans"), F.col("__pii_sorted")
    out = _with_spans(docs, F.coalesce(F.col(text_col), F.lit("")), "__pii_spans", *docs.columns)
    place = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = out.withColumn("__pii_sorted", F.when(F.size(found) > 1, F.array_sort(place)))
    overlap = F.exists(F.sequence(F.lit(1), F.size(sorted_) - 1), lambda i: F.get(sorted_, i)["start"] < F.get(sorted_, i - 1)["end"])
    out = out.withColumn("__pii_merged", F.when(sorted_.isNotNull() & overlap, _merged(sorted_)))
    text, merged = F.col(text_col), F.col("__pii_merged")

    def part(m: Column, i: Column) -> Column:
        since = F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, since + 1, m["start"] - since), F.lit("["), F.upper(m["kind"]), F.lit("]"))

    rest = F.substring(text, F.element_at(merged, -1)["end"] + 1, F.length(text))
    masked = F.concat(F.array_join(F.transform(merged, part), ""), rest)
    return out.withColumn(text_col, F.when(merged.isNotNull(), masked).otherwise(text)).select(docs.columns)


def _masking(kind: str, pieces: Column):
    """Replaces an accepted match by its kind."""
    def mask(value: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        keep = _holds(kind, value, before, after)
        if kind == "ssn":  # the others reach MIN_SCORE once their check holds
            keep = keep & _near(kind, before, after)
        return F.when(keep, F.lit(f"[{kind.upper()}]")).otherwise(value)
    return mask


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span replaced by its kind in brackets;
    overlapping spans are replaced as one. What becomes a span only by that is
    replaced too, one kind after the other. A null text stays null. Other
    columns stay as they are."""
    out = _cut_once(docs, text_col)
    for kind in KINDS:
        matches, pieces = "__pii_matches", "__pii_pieces"
        m, p = _cut(kind, F.coalesce(F.col(text_col), F.lit("")))
        out = out.withColumns({matches: m, pieces: p})
        mc, pc = F.col(matches), F.col(pieces)

        masked = F.concat(F.transform(mc, _masking(kind, pc)), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(pc, masked, lambda a, b: F.concat(a, b)), "")
        out = out.withColumn(text_col, F.when(F.size(mc) > 0, joined).otherwise(F.col(text_col))).drop(matches, pieces)
    return out


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts by kind, a hash of the base spans, and all spans as text."""
    def listed(kinds: tuple[str, ...]) -> Column:
        some = F.filter(F.col("spans"), lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(BASE_KINDS), 256).alias("base_sha256"), listed(KINDS).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS if k not in BASE_KINDS],
        F.size(F.filter(F.col("spans"), lambda s: s["context"])).cast("long").alias("n_in_context"))


def oracle_sql() -> str:
    """The digest of all ``documents`` in DuckDB SQL."""
    plain = dict(PATTERNS) | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT "
            f"ELSE (substr(reverse({digits}), i, 1)::INT * 2) % 10 + (substr(reverse({digits}), i, 1)::INT * 2) // 10 END)) % 10 = 0")
    turned = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
    mod = (f"list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN substr({turned}, i, 1) BETWEEN '0' AND '9' "
           f"THEN ascii(substr({turned}, i, 1)) - 48 ELSE ascii(substr({turned}, i, 1)) - 55 END)), lambda a, d: (a * CASE WHEN d < 10 THEN 10 ELSE 100 END + d) % 97) = 1")
    alone = "NOT regexp_matches(b, '[A-Za-z0-9-]$') AND NOT regexp_matches(a, '^[A-Za-z0-9-]')"
    holds = {
        "email": "true",
        "ip": f"regexp_matches(v, '^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$')",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN {alone} THEN {mod} ELSE false END",
        "ssn": f"{alone} AND NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$') AND near",
    }
    parts = []
    for n, k in enumerate(KINDS):
        near = f"regexp_matches(right(b, {CONTEXT_CHARS}), '{CONTEXT[k]}') OR regexp_matches(left(a, {CONTEXT_CHARS}), '{CONTEXT[k]}')"
        parts.append(
            f"SELECT rid, {n} AS kn, '{k}' AS kind, s, s + length(v) AS e, near FROM (SELECT *, ({near}) AS near FROM ("
            f"SELECT rid, i, m[i] AS v, p[i] AS b, p[i + 1] AS a, "
            f"list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s "
            f"FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{plain[k]}') AS m, "
            f"string_split_regex(t, '{plain[k]}') AS p FROM d)))) WHERE {holds[k]}")
    listed = "coalesce(string_agg({w}kind || ':' || s || ':' || e, ',' ORDER BY kn, s){f}, '')"
    base = listed.format(w="", f=f" FILTER (kn < {len(BASE_KINDS)})")
    counts = lambda ks: ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ks)
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        f"f AS ({' UNION ALL '.join(parts)}) "
        f"SELECT doc_id, {counts(BASE_KINDS)}, sha256({base}) AS base_sha256, {listed.format(w='', f='')} AS spans, "
        f"{counts(KINDS[len(BASE_KINDS):])}, count(*) FILTER (near) AS n_in_context "
        "FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id")
