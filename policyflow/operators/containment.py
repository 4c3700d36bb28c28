"""Name containment as equi joins.

"x stands inside y" for two sets of names is an equi join. Every distinct y is cut into its pieces of at most SEED characters, in proportion to its length; a short x
is joined by itself, a longer one by its rarest piece of SEED characters, and stands inside y if the rest agrees too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import cut

ANY = "*"


#: Characters of the piece that a longer name is looked up by.
SEED = 8


def _pieces(name: str, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(F.col(name), i, n)))


def inside(short: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    """(by, ``short``, ``long``) for non-empty ``short.name`` contained in ``long.name``, both columns ``by`` + ``name``."""
    short = short.select(*by, F.col("name").alias("short")).filter("short <> ''").distinct()
    long = long.select(*by, F.col("name").alias("long")).filter("long <> ''").distinct()
    # of pieces that many names share the least shared one, so that names with one beginning do not meet there
    parts = short.filter(F.length("short") > SEED).select(*by, "short", F.explode(_pieces("short", F.lit(SEED))).alias("piece"))
    shared = parts.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(shared, [*by, "piece"]).groupBy(*by, "short").agg(F.min(F.struct("n", "piece")).alias("p")).select(*by, "short", "p.piece")
    keyed = short.filter(F.length("short") <= SEED).withColumn("piece", F.col("short")).unionByName(rarest)
    # at most SEED rows
    lengths = F.broadcast(short.select(F.least(F.length("short"), F.lit(SEED)).alias("n")).distinct())
    sizes = long.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.length("long"), F.lit(SEED))))).join(lengths, "n", "left_semi")
    cells = sizes.select(*by, "long", F.explode(_pieces("long", F.col("n"))).alias("piece"))
    return cells.join(keyed, [*by, "piece"]).filter(F.contains(F.col("long"), F.col("short"))).select(*by, "short", "long")


def comparable(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, ``left``, ``right``) where one non-empty name contains the other."""
    a = inside(left, right, by).select(*by, F.col("short").alias("left"), F.col("long").alias("right"))
    b = inside(right, left, by).select(*by, F.col("long").alias("left"), F.col("short").alias("right"))
    return a.unionByName(b).distinct()


def _options(items: DataFrame, responses: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, ``side``, ``name``, ``key``): for each name column (the side) the response keys comparable to an item's name.

    The empty response name is comparable to every item; the empty item name to every response (key ``*``).
    """
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("name")) for c in columns])).alias("s")
    left = items.select(*by, sides).select(*by, "s.*").distinct()
    right = responses.select(*by, sides).select(*by, "s.*").distinct()
    named = comparable(left, right, [*by, "side"]).select(
        *by, "side", F.col("left").alias("name"), F.concat(F.lit("="), F.col("right")).alias("key")
    )
    empty = F.when(F.col("name") == "", F.lit(ANY)).otherwise(F.lit("="))
    return named.unionByName(left.withColumn("key", empty))


def _related(a: Column, b: Column) -> Column:
    """One name contains the other; an empty name is contained in all."""
    return F.contains(a, b) | F.contains(b, a)


def _nearest(rest: DataFrame, answers: DataFrame, options: DataFrame, by: list[str], benefit: str, template: str) -> DataFrame:
    """The first answer of each pair whose two names are both comparable.

    Each pair looks its answers up by the name that fewer answers are comparable to; the other name is tested on what is found. Answers with
    one name in common keep only the first of each other name, so the rows formed are at most the answers that the better name allows.
    """
    first = answers.groupBy(*by, benefit, template).agg(F.min("__ord").alias("__ord"))
    names_of = {}
    for own, other in ((benefit, template), (template, benefit)):
        keyed = first.select(
            *by, F.explode(F.array(F.concat(F.lit("="), F.col(own)), F.lit(ANY))).alias("key"), F.col(other).alias("__other"), "__ord"
        ).groupBy(*by, "key", "__other").agg(F.min("__ord").alias("__ord"))
        mine = options.filter(F.col("side") == own).select(*by, F.col("name").alias(own), "key")
        weight = mine.join(keyed.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("__n")), [*by, "key"])
        names_of[own] = (keyed, mine, weight.groupBy(*by, own).agg(F.sum("__n").alias(f"__n_{own}")))
    weighed = rest
    for own in (benefit, template):
        weighed = weighed.join(names_of[own][2], [*by, own])  # a name without answers has no match
    found = []
    for own, other, mine_first in ((benefit, template, F.col(f"__n_{benefit}") <= F.col(f"__n_{template}")), (template, benefit, F.col(f"__n_{benefit}") > F.col(f"__n_{template}"))):
        keyed, mine, _ = names_of[own]
        rows = weighed.filter(mine_first).select(*by, benefit, template).join(mine, [*by, own]).join(keyed, [*by, "key"])
        found.append(rows.filter(_related(F.col(other), F.col("__other"))).select(*by, benefit, template, "__ord"))
    return found[0].unionByName(found[1]).groupBy(*by, benefit, template).agg(F.min("__ord").alias("__ord"))


def match_responses(
    items: DataFrame, responses: DataFrame, benefit: str, template: str, values: list[str], pos: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Items with the values of their response and ``matched``.

    The exact trimmed pair wins; of several responses with one pair the last gives the values. Otherwise the first
    response in order counts whose benefit name and template name are each contained in the item's or contain it.
    Items with a null name never match.
    """
    by = by or []
    pair = [*by, benefit, template]
    keep = [c for c in items.columns if c not in by]
    probe = items.withColumns({"__b": tx.strip(F.col(benefit)), "__t": tx.strip(F.col(template))})
    wanted = probe.filter("__b is not null and __t is not null").select(
        *by, F.col("__b").alias(benefit), F.col("__t").alias(template)
    ).distinct()
    clean = responses.withColumns({c: tx.strip(tx.text_or_empty(F.col(c))) for c in (benefit, template)})
    # both are read by several branches
    answers = cut(clean.groupBy(*pair).agg(
        F.min(pos).alias("__ord"), F.max_by(F.struct(*values), F.col(pos)).alias("__hit")
    ))
    exact = wanted.join(answers, pair).select(*pair, "__ord")
    rest = cut(wanted.join(answers, pair, "left_anti"))
    options = _options(rest, answers, by, [benefit, template])
    near = _nearest(rest, answers, options, by, benefit, template)
    chosen = exact.unionByName(near).join(answers.select(*by, "__ord", "__hit"), [*by, "__ord"])
    chosen = chosen.select(*by, F.col(benefit).alias("__b"), F.col(template).alias("__t"), "__hit")
    joined = probe.join(chosen, [*by, "__b", "__t"], "left")
    return joined.select(
        *by, *keep,
        *[F.coalesce(F.col(f"__hit.{v}"), F.lit("")).alias(v) for v in values],
        F.col("__hit").isNotNull().alias("matched"),
    )


def reason(attribute_name: Column, sentence: Column, matched: Column, unmatched_text: str) -> Column:
    """'[attribute] sentence'; a fixed text when unmatched; '' when the match has no sentence."""
    tag = F.concat(F.lit("["), attribute_name, F.lit("] "))
    return (
        F.when(sentence != "", F.concat(tag, sentence))
        .when(~matched, F.concat(tag, F.lit(unmatched_text)))
        .otherwise("")
    )


def gated_sums(
    codes: DataFrame, structure: DataFrame, multiple: DataFrame, code: str, structure_key: str,
    leading: list[str], sums: dict[str, str],
) -> DataFrame:
    """Flags of a coverage code.

    Gate: some structure key contains the last seven characters of the code. Then the rows of ``multiple`` are taken
    whose cell equals the code in the first leading column that has any hit, and each measure is summed; a sum above
    zero sets the flag.
    """
    distinct = codes.select(F.col(code).alias("__code")).filter("__code is not null and __code <> ''").distinct()
    suffix = F.right("__code", F.lit(7))
    tails = distinct.select(suffix.alias("name")).distinct()
    keys = structure.select(F.col(structure_key).alias("name")).filter("name is not null").distinct()
    gate = inside(tails, keys, []).select(F.col("short").alias("__tail")).distinct()
    open_codes = distinct.join(gate, suffix == F.col("__tail"), "left_semi")
    cells = F.array(*[F.struct(F.lit(i).alias("no"), tx.strip(F.col(c).cast("string")).alias("cell")) for i, c in enumerate(leading)])
    measures = [F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(f"__{c}") for c in sums]
    long = multiple.select(F.explode(cells).alias("p"), *measures).select("p.no", "p.cell", *[f"__{c}" for c in sums])
    per = long.groupBy("cell", "no").agg(*[F.sum(f"__{c}").alias(f"__{c}") for c in sums])
    first = per.groupBy("cell").agg(F.min_by(F.struct(*[f"__{c}" for c in sums]), F.col("no")).alias("__sum"))
    hit = open_codes.join(first, F.col("__code") == F.col("cell"))
    flags = hit.select("__code", *[(F.col(f"__sum.__{c}") > 0).cast("int").alias(out) for c, out in sums.items()])
    joined = codes.join(flags, codes[code] == flags["__code"], "left")
    return joined.select(*codes.columns, *[F.coalesce(F.col(out), F.lit(0)).alias(out) for out in sums.values()])
