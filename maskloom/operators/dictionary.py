"""Dictionaries of known values, per file, and their places in free text.

Values of structured columns, their variants and the aliases they were given are literals. A text is searched for the
literals of its own file only. Both sides meet by the rarest piece of a literal at the places of the text, so literals
that begin alike do not all meet a text that holds their beginning; what meets is located and resolved, longest literal first, within the text's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import INCOMPLETE_DOMAINS, inside_identifier, is_cross_domain_sheet
from ..functions.text import alias_key, normalize, strip_honorific
from ..functions.variants import email_variants, name_variants, organization_variants, phone_variants, role_variants
from ..storage import materialize
from .alias import first_appearances, number_aliases
from .detect import match_offsets
from .resolve import greedy

PLACE = ["file_id", "sheet", "row", "col"]
SEEDED = (
    "company", "supplier", "organization", "customer_id", "ticket_id", "project_id", "project", "member_id", "employee_id", "email",
    "landline_phone", "mobile_phone", "phone", "emergency_phone",
)
CLASSES = (1, 2, 3, 4, 6, 12)  # characters by which literals of at least that length meet texts
HIT = "struct<start:int,end:int,category:string,score:double,text:string,literal:string,alias:string,single:boolean>"


def is_kana_header(header: Column) -> Column:
    return header.contains("カナ") | header.contains("かな")


def order_of(df: DataFrame) -> Column:
    """The order in which a workbook is read: sheets, rows, columns."""
    return F.struct("sheet_ord", "row", "col")


def primary_names(typed: DataFrame) -> DataFrame:
    """For each sheet the column whose names count: the first that is not in kana, else the first."""
    names = typed.filter(F.col("kind") == "name").groupBy("file_id", "sheet").agg(F.min(F.struct(is_kana_header(F.col("header")), "col")).alias("m"))
    return names.select("file_id", "sheet", F.col("m.col").alias("primary_col"))


def blank_landlines(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """Places under a landline header that hold nothing; each uses up a number where results leave the house."""
    heads = kinds.filter(F.col("kind") == "landline_phone").select("file_id", "sheet", "col")
    rows = cells.filter("row > 1").select("file_id", "sheet", "sheet_ord", "row").distinct()
    places = rows.join(heads, ["file_id", "sheet"]).join(cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select(*PLACE), PLACE, "left_anti")
    return places.select("file_id", F.lit("landline_phone").alias("kind"), F.struct("sheet_ord", "row", "col").alias("ord"))


def seed_aliases(typed: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(book, cell aliases) of structured columns of cells with kind and header.

    The book is (file_id, kind, norm_key, alias_no, alias); cell aliases are (place, alias): names in kana stand beside
    the primary name of their row and share its alias. On sheets of people from elsewhere every primary name takes a
    number of its own and is not in the book.
    """
    rows = shuffled(typed).join(shuffled(primary_names(typed)), ["file_id", "sheet"], "left").withColumn("elsewhere", is_cross_domain_sheet(F.col("sheet")))
    main = rows.filter((F.col("kind") == "name") & (F.col("col") == F.col("primary_col")))
    others = rows.filter(F.col("kind").isin(*SEEDED)).withColumn("elsewhere", F.lit(False))
    seeds = main.unionByName(others).withColumn("ord", order_of(main))
    own = F.concat(F.lit("\u0001"), F.col("sheet"), F.lit("\u0001"), F.col("row").cast("string"))  # no value has such a key
    seeds = seeds.withColumn("norm_key", F.when(F.col("elsewhere"), own).otherwise(alias_key(F.col("kind"), F.col("value"))))
    book = number_aliases(first_appearances(seeds, ["file_id"]), ["file_id"], extra)
    named = shuffled(seeds).join(shuffled(book), ["file_id", "kind", "norm_key"])
    mine = named.filter(F.col("kind") == "name").select(*PLACE, "alias")
    kana = rows.filter((F.col("kind") == "name") & is_kana_header(F.col("header")) & (F.col("col") != F.col("primary_col"))).select(*PLACE)
    beside = shuffled(kana).join(shuffled(mine.drop("col")), ["file_id", "sheet", "row"]).select(*PLACE, "alias")
    other = named.filter(F.col("kind") != "name").select(*PLACE, "alias")
    return book.filter(~F.col("norm_key").startswith("\u0001")), mine.unionByName(beside).unionByName(other)


def ambiguous_keys(typed: DataFrame) -> DataFrame:
    """(file_id, norm_key) of names that stand on a sheet of people from elsewhere and on another before it."""
    rows = shuffled(typed).join(shuffled(primary_names(typed)), ["file_id", "sheet"]).filter((F.col("kind") == "name") & (F.col("col") == F.col("primary_col")))
    rows = rows.select("file_id", alias_key(F.col("kind"), F.col("value")).alias("norm_key"), order_of(rows).alias("ord"), is_cross_domain_sheet(F.col("sheet")).alias("elsewhere"))
    first = rows.filter(~F.col("elsewhere")).groupBy("file_id", "norm_key").agg(F.min("ord").alias("first"))
    return shuffled(rows.filter("elsewhere")).join(shuffled(first), ["file_id", "norm_key"]).filter(F.col("ord") > F.col("first")).select("file_id", "norm_key").distinct()


def dictionary(typed: DataFrame, cell_aliases: DataFrame, replaced: Column | None = None) -> DataFrame:
    """(file_id, literal, label, alias, ord, single): the written forms of seeded values; of equal ones the last counts.

    ``replaced`` turns the alias of a value into its replacement where that is not the alias itself.
    """
    rows = typed.filter(~is_cross_domain_sheet(F.col("sheet")) | (F.col("kind") != "name"))
    rows = shuffled(rows).join(shuffled(cell_aliases), PLACE)
    value, kind = F.col("value"), F.col("kind")
    rows = rows.withColumn("alias", replaced if replaced is not None else F.col("alias"))
    forms = (
        F.when(kind == "name", name_variants(value)).when(kind.isin("company", "supplier", "organization"), organization_variants(value))
        .when(kind == "email", email_variants(value)).when(kind.isin("phone", "landline_phone", "mobile_phone", "emergency_phone"), phone_variants(value)).otherwise(F.array(normalize(value)))
    )
    wide = rows.select("file_id", "kind", "alias", order_of(rows).alias("ord"), F.explode(forms).alias("form"))
    label = F.when(F.col("kind") == "name", "氏名").otherwise(F.col("kind"))
    plain = wide.select("file_id", F.col("form").alias("literal"), label.alias("label"), "alias", "ord", (F.col("kind") == "name").alias("name"))
    roles = wide.filter("kind = 'name'").select("file_id", "ord", F.explode(role_variants(F.col("form"), F.col("alias"))).alias("r"))
    roles = roles.select("file_id", F.col("r.literal").alias("literal"), F.lit("氏名").alias("label"), F.col("r.alias").alias("alias"), "ord", F.lit(True).alias("name"))
    every = plain.unionByName(roles)
    one = F.col("name") & (F.length("literal") == 1)
    every = every.withColumn("single", one).filter(one | (F.length("literal") >= 2))
    last = every.groupBy("file_id", "literal", "single").agg(F.max(F.struct("ord", "label", "alias")).alias("v"), F.min("ord").alias("ord"))
    return last.select("file_id", "literal", "single", F.col("v.label").alias("label"), F.col("v.alias").alias("alias"), "ord")


def shuffled(df: DataFrame) -> DataFrame:
    """A table that a join must not broadcast: a small file, or rows unnested from it, can be many rows in memory."""
    return df.hint("merge")


def _class(length: Column) -> Column:
    """How many characters a literal meets texts by: the largest of ``CLASSES`` that it has."""
    of = F.lit(CLASSES[0])
    for n in CLASSES[1:]:
        of = F.when(length >= n, n).otherwise(of)
    return of


def _grams(text: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.lower(F.substring(text, i, n)))


def meeting(texts: DataFrame, words: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, literals): for each text the literals of its file that meet it: all that it contains, ASCII ones in any case,
    and few others.

    A literal meets texts by that of its pieces of up to 12 characters which the fewest literals of its file have.
    """
    own = words.filter(F.length("literal") > 0).withColumn("w", F.xxhash64("file_id", "literal", "single")).withColumn("n", _class(F.length("literal")))
    own = materialize(own, "dictionary-words")  # read three times
    pieces = own.select("file_id", "w", "n", F.explode(F.array_distinct(_grams(F.col("literal"), F.col("n")))).alias("gram"))
    pieces = pieces.withColumn("h", F.xxhash64("file_id", "n", "gram"))
    common = pieces.groupBy("h").agg(F.count("*").alias("many"))
    rarest = shuffled(pieces.select("w", "h")).join(shuffled(common), "h").groupBy("w").agg(F.min_by("h", F.struct("many", "h")).alias("h"))
    item = F.struct((-F.length("literal")).alias("n"), "ord", "literal", "label", "alias", "single")
    keyed = shuffled(own.select("w", F.col("file_id").alias("__file"), item.alias("item"))).join(shuffled(rarest), "w").select("h", "__file", "item")
    lengths = F.array(*[F.lit(n) for n in CLASSES])
    long_enough = F.filter(lengths, lambda n: n <= F.length(text))
    found = F.flatten(F.transform(long_enough, lambda n: F.array_distinct(F.transform(_grams(F.col(text), n), lambda g: F.xxhash64("file_id", n, g)))))
    places = texts.filter(F.length(text) > 0).select(*key, F.explode(found).alias("h"))
    pairs = shuffled(places).join(shuffled(keyed), "h").filter(F.col("__file") == F.col("file_id"))
    return pairs.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("literals"))


def literal_hits(texts: DataFrame, words: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Add ``hits``: places of literals in each text, in text order.

    Single family names count before honorifics and in front of ``です``, and come first; then longer literals before
    shorter ones. Names within e-mail addresses or identifiers do not count.
    """
    t = F.col(text)
    hit = lambda m, x, n, single: F.struct(
        m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), x["label"].alias("category"), n.cast("double").alias("score"),
        m["text"].alias("text"), x["literal"].alias("literal"), x["alias"].alias("alias"), F.lit(single).alias("single"),
    )
    quoted = lambda x: F.concat(F.when(x["literal"].rlike(r"^\p{ASCII}+$"), "(?i)").otherwise(""), F.lit("\\Q"), F.replace(x["literal"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    near = lambda x: F.concat(F.lit("(?<=の)"), x["literal"], F.lit("(?=です)|"), x["literal"], F.lit("さん"))
    alone = F.filter("literals", lambda x: x["single"])
    long_ = F.filter("literals", lambda x: ~x["single"])
    singles = F.flatten(F.transform(alone, lambda x: F.transform(match_offsets(t, near(x)), lambda m: hit(m, x, F.lit(10_000), True))))
    plain = F.flatten(F.transform(long_, lambda x: F.transform(match_offsets(t, quoted(x)), lambda m: hit(m, x, -x["n"], False))))
    plain = F.filter(plain, lambda h: (h["category"] != "氏名") | ~inside_identifier(t, h["start"], h["end"]))
    found = shuffled(texts).join(shuffled(meeting(texts, words, key, text)), key, "left")
    contained = lambda x: F.when(x["literal"].rlike(r"^\p{ASCII}+$"), F.lower(t).contains(F.lower(x["literal"]))).otherwise(t.contains(x["literal"]))
    found = found.withColumn("literals", F.filter("literals", contained))
    none = F.array().cast(f"array<{HIT}>")
    hits = F.when(F.col("literals").isNotNull(), greedy(F.concat(singles, plain).cast(f"array<{HIT}>"))).otherwise(none)
    return found.withColumn("hits", F.coalesce(hits, none)).drop("literals")


def candidate_keys(value: Column, alias: Column) -> tuple[Column, Column]:
    """(key, suffix) under which a doubtful name is numbered: its alias, else its form without honorific."""
    t = normalize(value)
    base = strip_honorific(t)
    return F.coalesce(alias, F.when(base != "", base).otherwise(t)), F.when(t.startswith(base), F.substring(t, F.length(base) + 1, F.length(t))).otherwise("")


def candidate_masks(found: DataFrame, scope: list[str], value: str = "original", alias: str = "alias") -> DataFrame:
    """Add ``mask``: doubtful names as numbered candidates with their honorific; numbers by first appearance (``ord``)."""
    key, suffix = candidate_keys(F.col(value), F.col(alias))
    keyed = found.withColumn("kind", F.lit("name_candidate")).withColumn("norm_key", key).withColumn("__s", suffix)
    book = number_aliases(first_appearances(keyed, scope), scope).withColumnRenamed("alias", "__a")
    out = shuffled(keyed).join(shuffled(book.drop("alias_no")), [*scope, "kind", "norm_key"], "left")
    return out.withColumn("mask", F.concat("__a", "__s")).drop("kind", "norm_key", "__s", "__a")


def incomplete_emails(values: DataFrame, book: DataFrame, scope: list[str], analysis: bool, value: str = "value") -> DataFrame:
    """Add ``mask`` for addresses without a whole domain: the number of the same name at a known domain, else an own one.

    The four domains are tried in their order; the others are numbered by first appearance (``ord``).
    """
    low = F.lower(normalize(F.col(value)))
    v = values.withColumn("__low", low).withColumn("__local", F.when(low.contains("@"), F.substring_index(low, "@", 1)))
    known = book.filter("kind = 'email'")
    domain = F.regexp_extract("norm_key", "@(.*)$", 1)
    rank = F.lit(None).cast("int")
    for i, d in enumerate(INCOMPLETE_DOMAINS):
        rank = F.when(domain == d, i).otherwise(rank)
    known = known.withColumn("__r", rank).filter(F.col("__r").isNotNull()).groupBy(*scope, F.substring_index("norm_key", "@", 1).alias("__local"))
    known = known.agg(F.min_by("alias", "__r").alias("__known"))
    v = v.join(known, [*scope, "__local"], "left")
    rest = v.filter(F.col("__known").isNull()).withColumn("kind", F.lit("email_candidate"))
    rest = rest.withColumn("norm_key", F.when(F.col("__low") != "", F.col("__low")).otherwise("メールアドレス"))
    own = number_aliases(first_appearances(rest, scope), scope).select(*scope, F.col("norm_key").alias("__low2"), F.col("alias").alias("__own"))
    key = F.when(F.col("__low") != "", F.col("__low")).otherwise("メールアドレス")
    out = v.withColumn("__low2", key).join(own, [*scope, "__low2"], "left")
    number = F.regexp_extract(F.coalesce("__known", "__own"), r"(\d{3})$", 1)
    number = F.when(number == "", "001").otherwise(number)
    inside = F.concat(F.lit("mail候補"), number, F.lit("@example.invalid"))
    mask = inside if analysis else F.when(F.col("__known").isNotNull(), F.concat(F.lit("メール候補"), number)).otherwise(F.col("__own"))
    return out.withColumn("mask", mask).drop("__low", "__low2", "__local", "__known", "__own")
