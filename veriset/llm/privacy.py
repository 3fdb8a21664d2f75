"""Personal data and the terms that give it away.

Direct identifiers (mail and IP addresses, card and phone numbers) are found by pattern. They are the protected entities;
co-occurrence in the corpus tells how strongly other terms reveal them. With IC(e) = log2(N / n(e)) and the pointwise
mutual information PMI(t, e) = log2(n(t, e) * N / (n(t) * n(e))) over the lines of all texts, PMI / IC is the share of the
entity's information that the term discloses: 1 if the term occurs with the entity only. Terms above the thresholds are
generalised or removed in the texts that hold the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.session import materialise

# Fixed patterns. They match what
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 12 digits or more            phone \+[0-9][\x20().0-9-]+[0-9]
# match from the left. Possessive repeats and the looks behind keep long runs linear and off the stack; a run's later
# places can't match where its first one doesn't, and chains of fewer digits would be dropped.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "general", "removed"]
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
NOT_TERM = r"[\p{L}\p{N}]"
GENERALISE = 0.8
REMOVE = 0.95


def _spans(body: Column, kind: str, pattern: Column | str) -> Column:
    """Array of (start, order, end, value) of a pattern's matches, in code points, from what lies between them."""
    between, found = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>")

    def add(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("value"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of the digits (19 at most) holds."""

    def term(acc, i):
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def base_spans(body: Column) -> Column:
    """Array of (start, kind_no, end, value) of all direct identifiers, in order of start, then kind."""
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>")

    def short(value: Column) -> Column:
        # Parts of up to three digits after leading zeros: longer ones exceed 255 in any case.
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def count_in(value: Column, low: int, high: int) -> Column:
        return F.length(_digits(value)).between(low, high)

    digit = body.rlike("[0-9]")
    email = F.when(body.contains("@"), _spans(body, "email", PATTERNS["email"])).otherwise(none)
    ip = F.when(digit & body.rlike(r"[0-9]\.[0-9]"), F.filter(_spans(body, "ip", PATTERNS["ip"]), lambda s: short(s["value"]))).otherwise(none)
    card = F.when(digit, F.filter(_spans(body, "card", PATTERNS["card"]), lambda s: F.when(count_in(s["value"], 12, 19), _luhn(_digits(s["value"]))).otherwise(False))).otherwise(none)
    phone = F.when(body.contains("+"), F.filter(_spans(body, "phone", PATTERNS["phone"]), lambda s: count_in(s["value"], 9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), number + 1)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _line_terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def disclosing_terms(contexts: DataFrame, corpus: DataFrame, text: str, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, share, action) from entity contexts (entity, term, line hash ``h``) and the whole corpus.

    A pair needs two different lines, so that copies of one line are no evidence.
    """
    # Lines of equal terms count as often as they occur, on both sides of the quotient.
    lines = corpus.select(F.explode(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n", -1)).alias("line"))
    counted = lines.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), _line_terms(F.col("line")))).alias("term"))
    # The null term counts the lines themselves.
    frequency = materialise(counted.groupBy(F.xxhash64("term").alias("t"), F.col("term").isNull().alias("all")).agg(F.count(F.lit(1)).alias("n_term")))
    total = frequency.where("all").agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    together = contexts.where("term is not null").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.min("h").alias("h1"), F.max("h").alias("h2")).where("h1 <> h2")
    alone = contexts.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    counts = together.withColumn("t", F.xxhash64("term")).join(frequency.where("not all"), "t").join(alone, "entity")
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(float(max(total, 1))) / (F.col("n_term") * F.col("n_entity")))
    share = counts.withColumn("share", F.when(information > 0, mutual / information).otherwise(0.0))
    return share.where(F.col("share") >= generalise).select("entity", "term", "share", F.when(F.col("share") >= remove, "removed").otherwise("general").alias("action"))


def sanitise(df: DataFrame, text: str = "text", key: str = "doc_id", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, base, spans, sanitised), one row for each row of ``df``.

    base: array of (start, kind_no, end, value) of direct identifiers; spans: those and the disclosing terms of the kinds
    general and removed. sanitised: the text with identifiers and general terms named by kind and removed terms left
    out; null where there is nothing to change. Null and empty texts have no spans. Repeated rows get equal spans; copies
    of a line are one piece of evidence. Other columns are not needed and may have any name.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = df.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), body.alias("body"), base_spans(body).alias("base"))
    # Texts without identifiers are not written.
    base = materialise(found.withColumn("body", F.when(F.size("base") > 0, F.col("body"))))
    held = base.where("body is not null")

    entity = lambda s: F.concat_ws(":", s["kind_no"].cast("string"), F.when(s["kind_no"] == 0, F.lower(s["value"])).when(s["kind_no"] == 1, s["value"]).otherwise(_digits(s["value"])))
    lines = held.select("row", "base", F.explode(F.split("body", "\n", -1)).alias("line"))
    within = lines.withColumn("own", F.filter("base", lambda s: F.contains(F.col("line"), s["value"]))).where(F.size("own") > 0)
    masked = F.aggregate("own", F.col("line"), lambda acc, s: F.replace(acc, s["value"], F.lit(" ")))
    pairs = within.select("row", F.xxhash64("line").alias("h"), F.array_distinct(F.transform("own", entity)).alias("entities"), F.concat(F.array(F.lit(None).cast("string")), _line_terms(masked)).alias("terms"))
    contexts = materialise(pairs.select("row", "h", F.explode("entities").alias("entity"), "terms").select("row", "h", "entity", F.explode("terms").alias("term")))

    telling = materialise(disclosing_terms(contexts, df, text, generalise, remove).select("entity", "term", "action"))
    marked = contexts.join(telling, ["entity", "term"]).groupBy("row", "term").agg(F.max("action").alias("action"))
    by_row = marked.groupBy("row").agg(*[F.collect_list(F.when(F.col("action") == a, F.col("term"))).alias(a) for a in ("general", "removed")])

    def located(action: str) -> Column:
        either = F.concat(F.lit(f"(?iu)(?<!{NOT_TERM})(?:"), F.array_join(F.array_sort(action), "|"), F.lit(f")(?!{NOT_TERM})"))
        return F.when(F.size(action) > 0, _spans(F.col("body"), action, either)).otherwise(F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>"))

    outside = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = held.join(by_row, "row").select("key", "body", "base", F.array_sort(F.concat("base", F.filter(F.concat(located("general"), located("removed")), outside))).alias("spans"))
    same = held.join(by_row, "row", "left_anti").select("key", "body", "base", F.col("base").alias("spans"))
    clean = base.where("body is null").select("key", "body", "base", F.col("base").alias("spans"))
    everything = more.unionByName(same).unionByName(clean)
    return everything.select(F.col("key").alias(key), "base", "spans", F.when(F.col("body").isNotNull(), _rewritten(F.col("body"), F.col("spans"))).alias("sanitised"))


def _rewritten(body: Column, spans: Column) -> Column:
    """The text with each span replaced; a span that begins inside an earlier one extends it."""

    def step(acc, s):
        name = F.when(s["kind_no"] == KINDS.index("removed"), F.lit("")).when(s["kind_no"] == KINDS.index("general"), F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(kind_name(s["kind_no"])), F.lit("]")))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), name)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
