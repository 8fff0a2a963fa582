"""Personal data: patterns find protected entities, and corpus co-occurrence finds what else reveals them.

Emails, IP addresses, card and phone numbers are found by patterns; what they find are protected entities. So are secrets: values of a key (``key = value``) that are
opaque, which is what keys are recognised by. Disclosure is pointwise mutual information as a share of the entity's information, log(P(e | t) / P(e)) / log(1 / P(e)): 1 if t
only occurs with e, 0 if t is independent of it. Frequencies count distinct texts of the whole corpus. Two kinds of terms are measured so.

- A key discloses secrets if the texts that hold it hold an opaque value of it, and other texts don't: with f texts that hold the key and o of them an opaque value,
  P(e | t) is (o + 1/2) / (f + 1). The values of a disclosing key are spans, opaque or not; opaque values of other keys, such as checksums, stay.
- A term discloses an entity e of the patterns with P(e | t) = f(t, e) / f(t). Terms anywhere in a text with the entity whose disclosure reaches the threshold are spans in
  each text of the corpus. In one or two texts every rare word reaches it by chance, so a term also needs one of three kinds of evidence: it meets the entity in enough
  texts; or an email's local part names it; or, for a number of fewer texts, which names nobody, it is written as a name, with a capital within a sentence.

Sanitising puts a general label for each span. All spans are [start, end) in code points. Everything is DataFrame operations; patterns give pieces and matches, from which
the positions follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut, fits, running, settled, text_key, united

KINDS = ("email", "ip", "card", "phone", "term", "secret")  # in the order of spans that begin alike
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "secret": "[SECRET]"}

# These match what the plain forms in the comments do, left to right without overlaps, but in linear time and without recursion on texts of any length: a
# match can only begin where a run of its characters begins, or where the match before ended.
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?![A-Za-z0-9.-])|\.\.)"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
#: a term with a capital that doesn't begin a sentence or line
NAME = r"(?<=[\p{L}\p{N},;:(] {1,2})\p{Lu}[\p{L}\p{N}]+"
#: a key, = or :, and its value, which may be quoted
KEYED = r"(?<![\p{L}\p{N}_.-])\p{L}[\p{L}\p{N}_.-]*+[ \t]*+[=:][ \t]*+[\"']?+[^\s\"'=:,;|<>]++"
KEY, VALUE = r"^[\p{L}\p{N}_.-]+", r"[^\s\"'=:,;|<>]+$"
#: opaque: long, and letters and digits in turn
OPAQUE = r"^(?=[A-Za-z]*(?:[0-9_+/-]+[A-Za-z]+){3})[A-Za-z0-9_+/-]{16,}$"
SALTS = 16


def _is_ip(found: Column) -> Column:
    part = lambda x: F.ltrim(x, F.lit("0"))  # noqa: E731  a number of any length
    return F.forall(F.split(found, r"\."), lambda x: (F.char_length(part(x)) < 3) | ((F.char_length(part(x)) == 3) & (part(x) <= "255")))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_card(found: Column) -> Column:
    """Luhn's test: from the right, each second digit counts twice, less 9 if above 9."""
    each = F.transform(F.array_remove(F.split(F.reverse(_digits(found)), ""), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _is_phone(found: Column) -> Column:
    return F.char_length(_digits(found)).between(10, 15)


#: kind: (a plain test without which there is no match, pattern, test of a match)
BASE = {
    "email": (lambda t: t.contains("@"), EMAIL, lambda x: F.lit(True)),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), IP, _is_ip),
    "card": (lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), CARD, _is_card),
    "phone": (lambda t: t.contains("+"), PHONE, _is_phone),
}
_SPAN = "array<struct<start:int,end:int,kind:int,found:string>>"


def _placed(text: Column, pattern: str | Column, matches: Column, kind: int) -> Column:
    """Spans of ``matches`` in order: before the i-th are the first i + 1 pieces between matches and the first i matches."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    moves = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: p + F.char_length(m))
    return F.zip_with(running(moves, F.lit(0), lambda s, x: s + x), matches, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("found")))


def _passes(test):
    return lambda s: test(s["found"])


def with_base(rows: DataFrame) -> DataFrame:
    """Add ``base``, the spans of the four kinds in the column ``t``, each kind in order: structs (start, end, kind, found)."""
    none = F.array().cast("array<string>")
    kept = rows.columns
    rows = rows.select("*", *[F.when(may(F.col("t")), F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1))).otherwise(none).alias(f"_{kind}") for kind, (may, pattern, _) in BASE.items()])
    spans = []
    for k, (kind, (_, pattern, test)) in enumerate(BASE.items()):
        own = F.filter(_placed(F.col("t"), pattern, F.col(f"_{kind}"), k), _passes(test))
        spans.append(F.when(F.size(f"_{kind}") > 0, own).otherwise(F.array().cast(_SPAN)))
    return settled(rows.select(*kept, F.concat(*spans).alias("base")), "base")


def _entity(span: Column) -> Column:
    """What an entity is recognised by: emails in lower case, of numbers the digits (of addresses also the dots)."""
    plain = F.when(span["kind"] == 0, F.translate(span["found"], UPPER, LOWER)).when(span["kind"] == 1, span["found"]).otherwise(_digits(span["found"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), plain)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def _replaced(text: Column, united: Column, label) -> Column:
    """The text with ``label`` of each of the united spans in its place."""
    nothing = F.array(F.struct(F.lit(0).alias("end")))
    ends = F.transform(united, lambda s: F.struct(s["end"].alias("end")))
    before = F.zip_with(united, F.concat(nothing, F.slice(ends, F.lit(1), F.size(united) - 1)), lambda s, p: F.concat(F.substring(text, p["end"] + 1, s["start"] - p["end"]), label(s)))
    return F.concat(F.array_join(before, ""), F.substring(text, F.element_at(united, -1)["end"] + 1, F.char_length(text)))


def _apart(end: Column, start: Column) -> Column:
    return start >= end


def with_rest(rows: DataFrame) -> DataFrame:
    """Add ``rest``: the text ``t`` with a 0 for each character of its ``base`` spans, so that places stay."""
    kept = rows.columns
    rows = rows.select("*", F.array_sort("base").alias("_sorted"))
    rows = rows.select("*", F.when(F.size("_sorted") > 0, united(F.col("_sorted"), _apart)).alias("_united"))
    zeros = _replaced(F.col("t"), F.col("_united"), lambda s: F.repeat(F.lit("0"), s["end"] - s["start"]))
    return settled(rows.select(*kept, F.when(F.col("_united").isNotNull(), zeros).otherwise(F.col("t")).alias("rest")), "rest")


def _key(found: Column) -> Column:
    """What a key is recognised by: a hash of it in lower case."""
    return F.xxhash64(F.translate(F.regexp_extract(found, KEY, 0), UPPER, LOWER))


def _value(found: Column) -> Column:
    return F.regexp_extract(found, VALUE, 0)


def _keyed(text: Column) -> Column:
    """The keys with their values in a text."""
    return F.when(text.contains("=") | text.contains(":"), F.regexp_extract_all(text, F.lit(f"({KEYED})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def owners(texts: DataFrame) -> DataFrame:
    """Rows (h, entities, terms, names, keys) of the texts with an entity or a key: a text's hash, its entities, the terms outside them, those of the terms that are written as
    names, and its keys, structs (key, opaque)."""
    found = with_rest(texts.select(text_key(F.col("t")).alias("h"), "t", "base"))
    found = found.select("h", "rest", F.array_distinct(F.transform("base", _entity)).alias("entities"), _keyed(F.col("rest")).alias("_keyed"))
    found = settled(found, "entities", "_keyed").where((F.size("entities") > 0) | (F.size("_keyed") > 0))
    own = F.size("entities") > 0
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.transform("_keyed", lambda x: F.struct(_key(x).alias("key"), _value(x).rlike(OPAQUE).alias("opaque"))))
    names = F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(f"({NAME})"), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    return found.select("h", "entities", F.when(own, F.array_distinct(_terms(F.col("rest")))).otherwise(none).alias("terms"), F.when(own, names).otherwise(none).alias("names"), keys.alias("keys"))


def disclosing_keys(met: DataFrame, total: int, *, disclosure: float = 0.9) -> DataFrame:
    """Rows (key, f_key, f_opaque, share) of the keys, told by a hash, that disclose secrets; ``met`` is what ``owners`` gives and ``total`` the number of distinct texts."""
    each = met.select("h", F.explode_outer("keys").alias("k")).where(F.col("k").isNotNull())
    each = each.groupBy("h", "k.key").agg(F.max(F.col("k.opaque").cast("int")).alias("opaque"))
    secret = (each.where("opaque = 1").agg(F.countDistinct("h")).first()[0] + 0.5) / (total + 1)
    rated = each.groupBy("key").agg(F.count("*").alias("f_key"), F.sum("opaque").alias("f_opaque")).where("f_opaque > 0")
    share = F.log((F.col("f_opaque") + 0.5) / (F.col("f_key") + 1) / secret) / F.log(F.lit(1 / secret))
    return rated.withColumn("share", share).where(F.col("share") >= disclosure)


def _named(entity: Column) -> Column:
    """What an email may name in its local part: the runs of letters, and of four letters or more what those begin and end with (jsmith: smith). A longer run than
    a local part may be is only taken whole."""
    runs = F.split(F.regexp_replace(F.substring_index(F.substring(entity, 3, 1 << 30), "@", 1), "[^a-z]+", " "), " ")
    size = lambda r: F.when(F.char_length(r).between(4, 64), F.sequence(F.lit(4), F.greatest(F.char_length(r), F.lit(4)))).otherwise(F.array().cast("array<int>"))
    each = F.transform(runs, lambda r: F.concat(F.array(r), F.transform(size(r), lambda n: F.left(r, n)), F.transform(size(r), lambda n: F.right(r, n))))
    return F.array_distinct(F.flatten(each))


def revealing_terms(texts: DataFrame, met: DataFrame, total: int, *, least_texts: int = 3, disclosure: float = 0.9, least_chars: int = 3, most_broadcast: int = 200_000) -> DataFrame:
    """Rows (h, term) of all texts, told by a hash, and the terms in them that disclose an entity.

    ``texts`` has the column ``t``, ``met`` is what ``owners`` gives and ``total`` the number of distinct texts. Candidates are the terms of at least ``least_chars`` characters, one of them a letter,
    that stand in a text with an entity and are supported by ``least_texts`` distinct texts with both, by the email's own name, or by being written as a name beside
    a number of fewer texts. Frequencies of entities and of candidate terms are counted over all distinct texts.
    """
    hashed = texts.select("t", text_key(F.col("t")).alias("h"))
    found = cut(met.select("h", F.explode("entities").alias("entity")).distinct())
    usable = (F.char_length("term") >= least_chars) & F.col("term").rlike(r"\p{L}")
    words = cut(met.select("h", F.explode("terms").alias("term"), "names").select("h", "term", F.array_contains("names", F.col("term")).alias("name")).where(usable).distinct())
    # A term's texts with any entity are a part of all its texts.
    beside = words.groupBy("term").agg(F.count("*").alias("f_beside"))
    rated = found.groupBy("entity").agg(F.count("*").alias("f_entity"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).where(F.col("f_entity") < total)
    rated = cut(rated.withColumn("number", ~F.col("entity").startswith("0:")))
    # entities of the same texts have the same frequencies with all terms, so one stands for them: a list of numbers doesn't meet a list of names pair by pair
    one = rated.groupBy("number", "f_entity", "x", "s").agg(F.min("entity").alias("entity")).drop("x", "s")
    heard = found.join(one, "entity")
    often = heard.where(F.col("f_entity") >= least_texts).join(words.join(beside.where(F.col("f_beside") >= least_texts).select("term"), "term"), "h").select("entity", "term", "h")
    often = often.groupBy("entity", "term").agg(F.count("*").alias("f_both")).where(F.col("f_both") >= least_texts)
    written = heard.where(F.col("number") & (F.col("f_entity") < least_texts)).select("entity", "h")
    written = written.join(words, "h").groupBy("entity", "term").agg(F.count("*").alias("f_both"), F.max("name").alias("name")).where("name").drop("name")
    parts = found.join(rated.where(~F.col("number")).select("entity"), "entity").select("h", "entity", F.explode(_named(F.col("entity"))).alias("term"))
    named = parts.join(words, ["h", "term"]).groupBy("entity", "term").agg(F.count("*").alias("f_both"))
    # Reaching the threshold bounds a term's frequency by f_both (N / f_entity) ** (1 - disclosure), so terms that exceed the bound beside entities, such as
    # function words, needn't be counted in the corpus.
    bound = F.col("f_both") * F.pow(total / F.col("f_entity").cast("double"), F.lit(1 - disclosure)) * 1.000001
    both = often.union(written).union(named).distinct().join(rated.select("entity", "f_entity"), "entity").join(beside, "term")
    both = cut(both.where(F.col("f_beside") <= bound).drop("f_beside"))
    if both.isEmpty():
        return words.select("h", "term").limit(0)
    asked = cut(both.select("term").distinct())
    small = fits(asked, most_broadcast, "term")
    each = hashed.select("h", F.explode_outer(F.array_distinct(_terms(F.col("t")))).alias("term")).where(F.col("term").isNotNull())
    if small:
        each = each.join(F.broadcast(asked), "term")
    else:  # words are many, and some are in every text: deal them out with salts
        salted = asked.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        each = each.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")
    each = cut(each.select("h", "term").distinct())
    frequent = each.groupBy("term").agg(F.count("*").alias("f_term"))
    share = F.log(total * F.col("f_both") / (F.col("f_term") * F.col("f_entity")).cast("double")) / F.log(total / F.col("f_entity").cast("double"))
    revealing = cut(both.join(F.broadcast(frequent) if small else frequent, "term").where(share >= disclosure - 1e-12).select("term").distinct())
    return cut(each.join(F.broadcast(revealing) if small else revealing, "term").select("h", "term"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 200_000, **how) -> DataFrame:
    """One row per document: ``id``, ``t`` (its text; null: empty), ``base`` and ``spans``.

    ``base`` are the spans of the patterns and ``spans`` those, the terms' and the secrets', sorted by start, then kind, as structs (start, end, kind, found); kind is an
    index of ``KINDS``. Terms and secrets don't overlap base spans. Very long texts are searched whole, in time that grows with their length and matches. Repeated rows have
    repeated results and count as one text; an empty table gives an empty result; other columns aren't read, so their names can't clash.
    """
    return _find(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), most_broadcast, how)


def _find(rows: DataFrame, most_broadcast: int, how: dict) -> DataFrame:
    """``rows`` has ``t`` and another column, which stays."""
    kept = rows.columns
    based = with_base(rows)
    met = cut(owners(with_base(rows.select("t"))))
    total = rows.select(text_key(F.col("t")).alias("h")).distinct().count()
    revealing = revealing_terms(rows, met, total, most_broadcast=most_broadcast, **how)
    keys = cut(disclosing_keys(met, total, **{k: v for k, v in how.items() if k == "disclosure"}).select("key"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(F.collect_set("term")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    terms_of = revealing.groupBy("h").agg(pattern.alias("pattern"))
    held = met.select("h", F.explode_outer("keys.key").alias("key")).where(F.col("key").isNotNull()).distinct()
    keys_of = held.join(F.broadcast(keys) if fits(keys, most_broadcast) else keys, "key").groupBy("h").agg(F.collect_set("key").alias("keys"))
    by_text = cut(terms_of.join(keys_of, "h", "full"))
    if by_text.isEmpty():
        return based.select(*kept, "base", F.array_sort("base").alias("spans"))
    few = fits(by_text, most_broadcast, "pattern", "keys")
    joined = based.withColumn("_h", text_key(F.col("t"))).join(F.broadcast(by_text) if few else by_text, F.col("_h") == F.col("h"), "left")
    joined = with_rest(joined).withColumn("_low", F.translate("rest", UPPER, LOWER))
    none = F.array().cast("array<string>")
    joined = joined.withColumn("_terms", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("_low", F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit(1))).otherwise(none))
    joined = joined.withColumn("_keyed", F.when(F.col("keys").isNotNull(), _keyed(F.col("rest"))).otherwise(none))
    terms = F.when(F.size("_terms") > 0, _placed(F.col("_low"), F.col("pattern"), F.col("_terms"), KINDS.index("term"))).otherwise(F.array().cast(_SPAN))
    values = F.filter(_placed(F.col("rest"), KEYED, F.col("_keyed"), KINDS.index("secret")), lambda s: F.array_contains("keys", _key(s["found"])))
    values = F.transform(values, lambda s: F.struct((s["end"] - F.char_length(_value(s["found"]))).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _value(s["found"]).alias("found")))
    joined = joined.select(*kept, "base", terms.alias("_more"), F.when(F.size("_keyed") > 0, values).otherwise(F.array().cast(_SPAN)).alias("_values"))
    return joined.select(*kept, "base", F.array_sort(F.concat("base", "_more", "_values")).alias("spans"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", most_broadcast: int = 200_000, **how) -> DataFrame:
    """The rows and columns of ``docs``, each span of the text replaced by a general label; ``chars_col``, if there, is the new text's length.

    Spans that overlap get one label, the first one's. Texts without spans, nulls and empty ones included, stay as they are. Very long texts are searched whole. Repeated rows
    have repeated results; an empty table gives an empty one. Rows travel as one struct, so that columns may have any names.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = _find(rows, most_broadcast, how)
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS])
    found = found.select("row", "t", F.when(F.size("spans") > 0, united(F.col("spans"), _apart)).alias("u"))
    text = _replaced(F.col("t"), F.col("u"), lambda s: F.get(labels, s["kind"]))
    found = found.select("row", F.when(F.col("u").isNotNull(), text).alias("new"))
    columns = []
    for c in names:
        old = F.col("row").getField(c)
        if c == text_col:
            columns.append(F.coalesce("new", old).alias(c))
        elif c == chars_col:
            columns.append(F.when(F.col("new").isNotNull(), F.char_length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return found.select(*columns)
