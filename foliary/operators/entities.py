"""Client names: clean, resolve, merge, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import fixed_values as fv
from foliary.functions import analysis as an
from foliary.functions import names
from foliary.functions.text import blank_to_null, strip, words
from foliary.operators.common import frequency, lookup_join, top_k
from foliary.session import cut_lineage


def by_distinct_value(df: DataFrame, column: str, compute, *outputs: str) -> DataFrame:
    """Apply a costly rule once per distinct value.

    Names repeat a lot, so the rule runs on the distinct names and the result
    is joined back.
    """
    key = f"_{column}_key"
    keyed = df.withColumn(key, F.col(column))
    table = keyed.select(key).filter(F.col(key).isNotNull()).distinct()
    table = compute(table, key).select(key, *outputs)
    return lookup_join(keyed, table, key).drop(key)


def clean_clients(rows: DataFrame, column: str = "client") -> DataFrame:
    """Adds ``client_clean_v1`` and ``flagged_garbage``."""
    raw = F.coalesce(F.col(column), F.lit(""))
    return rows.withColumn(
        "client_clean_v1", F.when(strip(raw) != "", names.clean_client(raw))
    ).withColumn("flagged_garbage", F.col("client_clean_v1").isNull())


def client_template(cleaned: DataFrame) -> DataFrame:
    """Distinct clean names by frequency, with an empty canonical column."""
    return frequency(cleaned, "client_clean_v1", "client_clean_v1").withColumn(
        "client_canonical", F.lit("")
    )


def override_table(rows: DataFrame, order: str | None = None) -> DataFrame:
    """``(key, override)``: filled overrides by lower-cased name, the last row
    of a name wins."""
    filled = rows.select(
        F.lower(strip(F.col("client_clean_v1"))).alias("key"),
        strip(F.col("client_canonical")).alias("override"),
        (F.col(order) if order else F.col("client_canonical")).alias("_order"),
    ).filter("key <> '' AND override <> ''")
    return filled.groupBy("key").agg(F.max_by("override", "_order").alias("override"))


def resolve_clients(
    rows: DataFrame,
    overrides: DataFrame,
    column: str = "client_clean_v1",
    per_row: bool = False,
) -> DataFrame:
    """Adds ``client_canonical`` and ``resolution_source``: override by
    lower-cased name, then rules, then the name itself.

    The rules run once per distinct name; with ``per_row`` on every row, which
    is better where the rows themselves are costly to compute.
    """

    def resolve(table: DataFrame, name: str) -> DataFrame:
        keyed = lookup_join(table.withColumn("key", F.lower(name)), overrides, "key")
        resolved = keyed.withColumn("_r", names.resolved(F.col(name), F.col("override")))
        return resolved.withColumns(
            {
                "client_canonical": F.col("_r.client_canonical"),
                "resolution_source": F.col("_r.resolution_source"),
            }
        ).drop("key", "override", "_r")

    if per_row:
        return resolve(rows, column)
    return by_distinct_value(rows, column, resolve, "client_canonical", "resolution_source")


def clients_from_analysis(rows: DataFrame, attack: bool = True) -> DataFrame:
    """Adds ``client_from_ai``, ``ai_confidence`` and ``source_tier`` from the
    analysis JSON: mappings, then summary patterns, then attack patterns."""
    text = F.col("ai_analysis")
    given = F.coalesce(~strip(text).isin("", "NULL", "None"), F.lit(False))
    parsed = rows.withColumns(
        {
            "_a": F.when(given, an.parse_analysis(text)),
            "_broken": given & ~an.is_json(text),
        }
    ).withColumns(
        {
            "_m": F.coalesce("_a.keyword_mappings", an.no_mappings()),
            "_s": F.coalesce("_a.summary", F.lit("")),
        }
    )
    found = names.name_from_analysis(F.col("_m"), F.col("_s"), F.col("_broken"), attack)
    named = parsed.withColumn("_f", F.when(given, found))
    return named.withColumns(
        {
            "client_from_ai": F.col("_f.client_from_ai"),
            "ai_confidence": F.col("_f.ai_confidence"),
            "source_tier": F.col("_f.source_tier"),
        }
    ).drop("_a", "_broken", "_m", "_s", "_f")


def join_predictions(predictions: DataFrame, found: DataFrame) -> DataFrame:
    """Predictions with the names found by the model, if any."""
    return predictions.join(
        found.select("id", "client_from_ai", "ai_confidence", "source_tier"), "id", "left"
    )


def merge_clients(predictions: DataFrame, found: DataFrame) -> DataFrame:
    """``client_canonical`` and ``canonical_source`` of each prediction."""
    joined = join_predictions(predictions, found)
    clean_raw = strip(
        F.coalesce(blank_to_null(F.col("client_clean_v1")), F.col("client"), F.lit(""))
    )
    prepared = joined.withColumns(
        {"_clean": clean_raw, "client_raw": F.col("client")}
    ).withColumns(
        {
            "client_clean_v1": F.coalesce(
                blank_to_null(names.clean_fallback_name(blank_to_null(F.col("_clean")))),
                F.col("_clean"),
            ),
            "_ai": names.clean_ai_name(blank_to_null(F.col("client_from_ai"))),
        }
    )
    merged = names.merged(
        F.col("client_clean_v1"), F.col("_ai"), F.col("ai_confidence"), F.col("source_tier")
    )
    return prepared.withColumn("_m", merged).select(
        "id",
        "filename",
        "client_raw",
        "client_clean_v1",
        "client_from_ai",
        "ai_confidence",
        F.col("_m.client_canonical"),
        F.col("_m.canonical_source"),
    )


def merge_with_agreement(rows: DataFrame) -> DataFrame:
    """The one-document merge: ``resolved`` against ``client_from_ai``, the
    clean name winning where both are nearly the same string."""
    prepared = rows.withColumns(
        {
            "_clean": F.coalesce(
                blank_to_null(names.clean_fallback_name(F.col("resolved"))), F.col("resolved")
            ),
            "_ai": names.clean_ai_name(F.col("client_from_ai")),
        }
    )
    both = F.col("_clean").isNotNull() & F.col("_ai").isNotNull()
    same = F.lower("_clean") == F.lower("_ai")
    # equal names need no trip to Python
    ratio = F.when(both & same, F.lit(1.0)).when(both, names.string_ratio("_clean", "_ai"))
    rated = prepared.withColumn("_ratio", F.coalesce(ratio, F.lit(0.0)))
    merged = names.merged(
        F.col("_clean"),
        F.col("_ai"),
        F.col("ai_confidence"),
        F.col("source_tier"),
        F.col("_ratio"),
    )
    return (
        rated.withColumn("_m", merged)
        .withColumns(
            {
                "client_canonical": F.col("_m.client_canonical"),
                "canonical_source": F.col("_m.canonical_source"),
            }
        )
        .drop("_clean", "_ai", "_ratio", "_m")
    )


# --- names in mapping rows -------------------------------------------------


def candidate_names(mappings: DataFrame) -> DataFrame:
    """Most frequent exact candidate name per document, opponents excluded, the
    first seen winning ties.  Works on mapping rows instead of arrays."""
    entries = mappings.filter(
        (F.col("mapped_primary_category") == fv.MAPPING_CATEGORY)
        & (F.size(words(F.col("verbatim_term"))) >= 2)
    ).withColumn("name", names.clean_found_name(strip(F.col("verbatim_term"))))
    opponents = (
        entries.filter(F.col("mapped_subcategory") == fv.MAPPING_OPPONENT)
        .select("document_id", F.lower("name").alias("lowered"))
        .distinct()
    )
    candidates = (
        entries.filter(
            (F.col("mapped_subcategory") == fv.MAPPING_CANDIDATE)
            & (F.col("mapped_canonical_term") == fv.MAPPING_NAME_TERM)
        )
        .groupBy("document_id", "name")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
        .withColumn("lowered", F.lower("name"))
    )
    kept = candidates.join(opponents, ["document_id", "lowered"], "left_anti")
    return kept.groupBy("document_id").agg(
        F.max_by("name", F.struct("n", -F.col("first_pos"))).alias("name")
    )


# --- audit -----------------------------------------------------------------


def client_frequency(rows: DataFrame) -> DataFrame:
    """Raw spellings with document counts and comparison form."""
    raw = strip(F.col("client"))
    return (
        frequency(rows.filter(raw != ""), raw, "client_raw")
        .withColumn("normalized", names.comparison_form(F.col("client_raw")))
    )


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Spellings that share a comparison form with other spellings, one row per
    spelling, beside the group's totals."""
    counted = client_frequency(rows)
    groups = (
        counted.groupBy("normalized")
        .agg(F.count("*").alias("spellings"), F.sum("count").alias("documents"))
        .filter(F.col("spellings") > 1)
    )
    return lookup_join(counted, groups, "normalized", "inner")


# --- near duplicates -------------------------------------------------------

# up to this many words all word subsets of a name are enumerated
_ENUMERATED_WORDS = 12
# common rare words that bring two longer names together
_PREFIX_WORDS = 3


def _overlap_needed(n: Column, m: Column, threshold: float) -> Column:
    """Least number of shared words for the similarity to reach the threshold."""
    share = threshold / (1 + threshold)
    return F.greatest(F.ceil((n + m) * F.lit(share) - F.lit(1e-9)).cast("int"), F.lit(1))


def _word_sets(named: DataFrame) -> DataFrame:
    """``(node, tokens)``: distinct word sets, words rarest first, numbered by
    the first appearance of one of their names."""
    ordered = F.array_sort(F.array_distinct(words(F.col("name"))))
    sets = named.select("place", ordered.alias("tokens")).filter(F.size("tokens") > 0)
    nodes = sets.groupBy("tokens").agg(F.min("place").alias("node"))
    tokens = nodes.select("node", F.explode("tokens").alias("token"))
    weights = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = lookup_join(tokens, weights, "token", "inner")
    by_rarity = F.array_sort(F.collect_list(F.struct("df", "token")))
    return ranked.groupBy("node").agg(
        F.transform(by_rarity, lambda x: x["token"]).alias("tokens")
    )


def _partner_sizes(sets: DataFrame, threshold: float) -> DataFrame:
    """Each set beside every size ``m`` a similar set may have and the number
    ``o`` of words they must share."""
    n = F.col("n")
    low = F.greatest(F.ceil(n * threshold - 1e-9).cast("int"), F.lit(1))
    high = F.floor(n / threshold + 1e-9).cast("int")
    return (
        sets.withColumn("n", F.size("tokens"))
        .withColumn("m", F.explode(F.sequence(low, high)))
        .withColumn("o", _overlap_needed(n, F.col("m"), threshold))
        # of equal sizes and all words shared is only the set itself
        .filter(~((F.col("n") == F.col("m")) & (F.col("o") >= n)))
    )


def _subsets(tokens: Column, size: Column) -> Column:
    """All subsets of ``size`` tokens, as strings.  Sets that have already left
    out too many tokens are not continued."""
    spare = F.size(tokens) - size
    start = F.array(F.struct(F.lit("").alias("words"), F.lit(0).alias("omitted")))

    def grow(sets, w):
        taken = F.transform(
            sets,
            lambda s: F.struct(
                F.concat(s["words"], F.lit(" "), w).alias("words"), s["omitted"].alias("omitted")
            ),
        )
        skipped = F.transform(
            F.filter(sets, lambda s: s["omitted"] < spare),
            lambda s: F.struct(s["words"].alias("words"), (s["omitted"] + 1).alias("omitted")),
        )
        return F.concat(taken, skipped)

    grown = F.aggregate(tokens, start, grow)
    return F.transform(
        F.filter(grown, lambda s: s["omitted"] == spare), lambda s: s["words"]
    )


def _enumerated_keys(sized: DataFrame) -> DataFrame:
    """For shorter names: two sets of sizes ``n`` and ``m`` are similar exactly
    when they have a subset of ``o`` words in common, so membership in a key
    already is similarity and no pair of names is ever formed."""
    rows = sized.filter((F.col("n") <= _ENUMERATED_WORDS) & (F.col("m") <= _ENUMERATED_WORDS))
    rows = rows.withColumn("subset", F.explode(_subsets(F.col("tokens"), F.col("o"))))
    return rows.select(
        "node",
        F.concat_ws("/", "n", "m", "subset").alias("shows"),
        F.concat_ws("/", "m", "n", "subset").alias("sees"),
    )


def _long_name_pairs(sized: DataFrame, threshold: float) -> DataFrame:
    """For longer names: similar sets share up to three words among their first
    ``n - o + 3`` rarest, so they meet under that combination of rare words and
    are then compared."""
    take = F.least("o", F.lit(_PREFIX_WORDS))
    prefix = F.slice("tokens", F.lit(1), F.least(F.col("n"), F.col("n") - F.col("o") + take))
    rows = sized.filter((F.col("n") > _ENUMERATED_WORDS) | (F.col("m") > _ENUMERATED_WORDS))
    rows = rows.withColumns({"take": take, "prefix": prefix})
    keys = rows.select("node", "tokens", "n", "m", F.explode(_combinations()).alias("words"))
    other = keys.select(
        F.col("node").alias("other"),
        F.col("tokens").alias("other_tokens"),
        F.col("m").alias("n"),
        F.col("n").alias("m"),
        "words",
    )
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    total = F.size("tokens") + F.size("other_tokens") - shared
    return (
        keys.join(other, ["n", "m", "words"])
        .filter((F.col("node") != F.col("other")) & (shared / total >= threshold))
        .select("node", "other")
        .distinct()
    )


def _combinations() -> Column:
    """All combinations of ``take`` (up to three) words of ``prefix``."""
    p, size = F.col("prefix"), F.size("prefix")

    def rest(i):
        return F.slice(p, i + 2, F.greatest(size - i - 1, F.lit(0)))

    def longer(sets):
        # extend each (last position, words) by every later word
        return F.flatten(
            F.transform(
                sets,
                lambda s: F.transform(
                    rest(s["at"]),
                    lambda w, j: F.struct(
                        (s["at"] + j + 1).alias("at"),
                        F.concat_ws(" ", s["words"], w).alias("words"),
                    ),
                ),
            )
        )

    ones = F.transform(p, lambda w, i: F.struct(i.alias("at"), w.alias("words")))
    twos = longer(ones)
    threes = longer(twos)
    chosen = (
        F.when(F.col("take") == 1, ones).when(F.col("take") == 2, twos).otherwise(threes)
    )
    return F.transform(chosen, lambda s: s["words"])


def near_duplicate_groups(
    named: DataFrame, threshold: float = fv.NEAR_DUPLICATE_THRESHOLD
) -> DataFrame:
    """``(place, name, seed)``: names in groups around a seed.

    ``named`` holds distinct names with their order of first appearance
    (``place``).  Walking in that order, a name that is in no group yet becomes
    a seed and takes all similar names that are in no group yet.  The seeds are
    found in rounds: a set with no similar undecided set before it is a seed,
    sets similar to a seed are settled, the rest goes into the next round.

    Similar sets find each other through keys (see above); per key only the
    first undecided set is passed on, never the pairs.
    """
    sets = cut_lineage(_word_sets(named))
    sized = _partner_sizes(sets, threshold)
    enumerated = _enumerated_keys(sized)
    pairs = _long_name_pairs(sized, threshold).select(
        "node", F.concat(F.lit("#"), F.col("other").cast("string")).alias("sees")
    )
    shows = enumerated.select("node", F.col("shows").alias("key")).unionByName(
        sets.filter(F.size("tokens") > _ENUMERATED_WORDS * threshold).select(
            "node", F.concat(F.lit("#"), F.col("node").cast("string")).alias("key")
        )
    )
    sees = enumerated.select("node", F.col("sees").alias("key")).unionByName(
        pairs.withColumnRenamed("sees", "key")
    )
    shows, sees = cut_lineage(shows), cut_lineage(sees)

    def first_seen(viewers: DataFrame, shown_by: DataFrame) -> DataFrame:
        """For each viewer the first of the given nodes it is similar to."""
        firsts = (
            shows.join(shown_by, "node", "left_semi")
            .groupBy("key")
            .agg(F.min("node").alias("first"))
        )
        views = sees.join(viewers, "node", "left_semi")
        return (
            lookup_join(views, firsts, "key", "inner")
            .groupBy("node")
            .agg(F.min("first").alias("first"))
        )

    undecided = sets.select("node")
    seeds = undecided.limit(0)
    while not undecided.isEmpty():
        ahead = first_seen(undecided, undecided)
        blocked = ahead.filter(F.col("first") < F.col("node"))
        found = cut_lineage(undecided.join(blocked, "node", "left_anti"))
        seeds = seeds.unionByName(found)
        settled = first_seen(undecided, found).select("node")
        undecided = cut_lineage(
            undecided.join(found, "node", "left_anti").join(settled, "node", "left_anti")
        )
    adjacent = first_seen(sets.select("node"), seeds).withColumnRenamed("first", "seed")
    grouped = sets.select("node", F.array_sort("tokens").alias("words")).join(
        adjacent.join(seeds, "node", "left_anti")
        .unionByName(seeds.withColumn("seed", F.col("node"))),
        "node",
    )
    members = named.select(
        "place", "name", F.array_sort(F.array_distinct(words(F.col("name")))).alias("words")
    ).join(grouped.select("words", "seed"), "words")
    sizes = members.groupBy("seed").agg(F.count("*").alias("members")).filter("members > 1")
    return lookup_join(members, sizes, "seed", "inner").select("place", "name", "seed")


def first_appearance(rows: DataFrame, column: str, order: str) -> DataFrame:
    """``(place, name)``: distinct comparison forms with their first position."""
    name = names.comparison_form(F.col(column))
    return (
        rows.filter(strip(F.col(column)) != "")
        .groupBy(name.alias("name"))
        .agg(F.min(order).alias("place"))
        .select("place", "name")
    )


# --- run reports -----------------------------------------------------------


def cleaning_report(cleaned: DataFrame, raw: str = "client") -> DataFrame:
    """Changed, unchanged and garbage names, distinct clean names."""
    clean = F.col("client_clean_v1")
    same = F.lower(clean) == F.lower(strip(F.col(raw)))
    return cleaned.agg(
        F.count_if(clean.isNotNull() & ~same).alias("changed"),
        F.count_if(clean.isNotNull() & same).alias("unchanged"),
        F.count_if(clean.isNull()).alias("garbage"),
        F.countDistinct(clean).alias("distinct_names"),
    )


def count_by(rows: DataFrame, column: str, empty: str = "null") -> DataFrame:
    """Rows per value of a label column, ``empty`` for none."""
    label = F.coalesce(blank_to_null(F.col(column)), F.lit(empty))
    return rows.groupBy(label.alias(column)).agg(F.count("*").alias("count"))


def review_report(extracted: DataFrame) -> DataFrame:
    return extracted.agg(
        F.count("*").alias("total"), F.count_if("needs_review").alias("flagged")
    )


def top_canonical(resolved: DataFrame, limit: int = 15) -> DataFrame:
    return top_k(
        frequency(resolved, blank_to_null(F.col("client_canonical")), "name"), limit, "count", "name"
    )
