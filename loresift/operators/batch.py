"""Ranked search for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresift.functions import bm25
from loresift.functions.once import computed_once
from loresift.functions.paths import all_of
from loresift.functions.since import since_bound
from loresift.functions.text import tokens
from loresift.operators.clauses import ALL, ANY
from loresift.operators.search import DEFAULT_LIMIT, MAX_LIMIT, present
from loresift.operators.skew import salted_join
from loresift.schema import Corpus

#: Largest table, in bytes, that is broadcast; its size is measured first and
#: beyond it the same join is done by a salted shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a clause row besides its term, and of a hit's keys, at most on average.
_CLAUSE_BYTES, _HIT_BYTES = 256, 512

# Optional query columns that narrow down documents by equality, and by a least and a greatest value.
_EQUALITY = ("project", "session_id", "event_role", "cwd", "git_branch", "repo", "language", "branch", "file_path")
_RANGES = ("event_index", "size_bytes", "timestamp")
_ENDS = {f"{field}_{end}": (field, end) for field in _RANGES for end in ("min", "max")}

#: A quoted phrase, or a word.
_PIECES = r'(?U)"[^"]*"?|[^\s"]+'


def _checked(match: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("match is any or all, not "), match))
    return F.when(match.isin(ANY, ALL), match).otherwise(wrong)


def _group(match: Column, pieces: Column) -> Column:
    """How a group's clauses are joined, and the terms of each; pieces without terms are none."""
    clauses = F.filter(F.transform(pieces, tokens), lambda t: F.size(t) > 0)
    return F.struct(_checked(match).alias("match"), clauses.alias("clauses"))


def query_clauses(queries: DataFrame, match: str = ANY) -> DataFrame:
    """One row per term of every clause of every group: a word, or a phrase of several terms.

    A query is its text, whose words and quoted phrases are one group, or, where
    there is one, its ``groups``: (match, pieces). ``match`` joins what it is made of.
    """
    joined = F.lit(match)
    if "match" in queries.columns:
        joined = F.coalesce("match", joined)
    text = F.array(_group(joined, F.regexp_extract_all("query", F.lit(_PIECES), F.lit(0))))
    parsed, outer = text, F.lit(ANY)
    if "groups" in queries.columns:
        given = F.transform("groups", lambda g: _group(F.coalesce(g["match"], F.lit(ANY)), g["pieces"]))
        parsed = F.when(F.col("groups").isNotNull(), given).otherwise(text)
        outer = F.when(F.col("groups").isNotNull(), _checked(joined)).otherwise(outer)
    parsed = F.filter(parsed, lambda g: F.size(g["clauses"]) > 0)
    kept = [c for c in queries.columns if c not in ("query", "match", "groups")]
    grouped = queries.select(*kept, parsed.alias("parsed"), outer.alias("outer"))
    grouped = grouped.select(
        *kept, F.when(F.col("outer") == ALL, F.size("parsed")).otherwise(1).alias("groups_needed"),
        F.posexplode("parsed").alias("group_id", "group"),
    )
    exploded = grouped.select(
        *kept, "groups_needed", "group_id",
        F.when(F.col("group.match") == ALL, F.size("group.clauses")).otherwise(1).alias("n_needed"),
        F.posexplode("group.clauses").alias("clause_id", "clause"),
    )
    return exploded.select(
        *[c for c in exploded.columns if c != "clause"],
        F.size("clause").alias("width"),
        F.posexplode("clause").alias("offset", "term"),
    )


def _weighted(index, clauses: DataFrame) -> DataFrame:
    """Clauses with ``idf`` and ``avg_dl``, one row per scope that has the term.

    Clauses that name their scope meet its terms only.
    """
    scope = list(index.corpus.scope)
    terms = index.dictionary_of(clauses.select("term").distinct())
    stats = index.stats().select(*scope, "n_docs", (F.col("sum_dl") / F.col("n_docs")).alias("avg_dl"))
    if scope:
        named = {c: f"in_{c}" for c in scope}
        known = terms.join(stats, scope).withColumnsRenamed(named)
        if all(f"q_{c}" in clauses.columns for c in scope):
            own = all_of([F.col(f"q_{c}").isNotNull() for c in scope])
            mine = clauses.filter(own).withColumns({f"in_{c}": F.col(f"q_{c}") for c in scope})
            parts = [mine.join(known, ["term", *named.values()]), clauses.filter(~own).join(known, "term")]
            known = parts[0].unionByName(parts[1])
        else:
            known = clauses.join(known, "term")
    else:
        one = clauses.join(terms, "term").withColumn("stats", stats.select(F.struct("n_docs", "avg_dl")).scalar())
        known = one.select(*[c for c in one.columns if c != "stats"], "stats.n_docs", "stats.avg_dl")
    return known.withColumn("idf", bm25.idf(F.col("n_docs"), F.col("df"))).drop("n_docs", "df")


def _conditions(options: list[str], field: Callable[[str], Column] = F.col, option: Callable[[str], Column] = F.col) -> list[Column]:
    """What documents a query's options leave; a null option leaves all."""

    def kept(column: str, bound: Column, low: bool) -> Column:
        return F.coalesce(field(column) >= bound if low else field(column) <= bound, bound.isNull())

    found = [field(c).eqNullSafe(F.coalesce(option(f"q_{c}"), field(c))) for c in options if c in _EQUALITY]
    found += [kept(_ENDS[c][0], option(f"q_{c}"), _ENDS[c][1] == "min") for c in options if c in _ENDS]
    if "since" in options:
        found.append(kept("timestamp", option("q_since"), True))
    return found


def _phrases_of_documents(
    rows: DataFrame, terms: DataFrame, weighted: DataFrame, corpus: Corpus, by: list[str], options: list[str], carried: list[str]
) -> DataFrame:
    """Phrases with all their terms in a document: ``by``, its keys, ``starts``, ``idf``, ``dl``, ``avg_dl``.

    The postings of a document meet first, in one row, and so are shuffled once
    and not once a query; clauses are few and are brought to that row.
    """
    scope, keys = list(corpus.scope), list(corpus.keys)
    pieces = F.struct("idf", "offset", "term", "avg_dl", *[f"q_{c}" for c in options])
    asked = weighted.withColumnsRenamed({f"in_{c}": f"of_{c}" for c in scope})
    asked = asked.groupBy(*by, "clause_id", *[f"of_{c}" for c in scope]).agg(
        F.sort_array(F.collect_list(pieces), asc=False).alias("pieces"), F.first("width").alias("width")
    )
    of_pieces = F.posexplode(F.transform("pieces", lambda p: p["term"])).alias("nth", "of_term")
    asked = asked.select("*", (F.size("pieces") > F.col("width")).alias("doubled"), of_pieces)
    held = rows.join(F.broadcast(terms), "term", "left_semi").groupBy(*keys)
    held = held.agg(F.collect_list(F.struct("term", "positions", "dl", *dict.fromkeys(carried))).alias("held"))
    held = held.withColumn("terms", F.array_distinct(F.transform("held", lambda h: h["term"])))
    # rows that repeat a document's keys, and queries that repeat an id, count together, so one may lack what others have
    held = held.withColumn("repeated", F.size("held") > F.size("terms")).withColumn("term", F.explode("terms"))
    same = [F.col(c) == F.col(f"of_{c}") for c in [*scope, "term"]]
    # a clause is looked at once, by the rarest of its terms that the document has
    met = held.join(F.broadcast(asked), all_of([*same, (F.col("nth") == 0) | F.col("repeated") | F.col("doubled")]))
    rarer = F.exists(F.slice("pieces", 1, F.col("nth")), lambda p: F.array_contains("terms", p["term"]))
    every = F.forall("pieces", lambda p: F.array_contains("terms", p["term"]))
    met = met.filter(F.when(F.col("repeated") | F.col("doubled"), ~rarer).otherwise(every))

    def matching(piece: Column) -> Column:
        def kept(row: Column) -> Column:
            return all_of([row["term"] == piece["term"], *_conditions(options, lambda c: row[c], lambda c: piece[c])])

        def placed(row: Column) -> Column:
            starts = F.transform(row["positions"], lambda at: at - piece["offset"])
            return F.struct(starts.alias("starts"), piece["idf"].alias("idf"), row["dl"].alias("dl"), piece["avg_dl"].alias("avg_dl"))

        return F.transform(F.filter("held", kept), placed)

    found = computed_once(
        met.select(*by, *keys, "clause_id", "pieces", "held", "width"), matched=F.flatten(F.transform("pieces", matching))
    )
    found = found.filter(F.size("matched") == F.col("width"))
    return found.select(
        *by, *keys, "clause_id",
        F.aggregate("matched", F.lit(0.0), lambda held, m: held + m["idf"]).alias("idf"),
        F.col("matched.starts").alias("starts"),
        F.get("matched", F.lit(0))["dl"].alias("dl"),
        F.get("matched", F.lit(0))["avg_dl"].alias("avg_dl"),
    )


def batch_search(index, queries: DataFrame, match: str = ANY, now: datetime | None = None) -> DataFrame:
    """Ranked hits per query: ``query_id``, ``rank`` and the hit columns.

    ``queries`` holds ``query_id`` and ``query``, a text of words and quoted
    phrases. Optional columns, null for none: ``match`` (any or all), ``groups``
    (an array of (match, pieces) in place of the text), ``limit``, ``since``,
    fields for equality, and ``<field>_min`` and ``<field>_max`` for ranges.
    """
    index = index.pinned()
    corpus = index.corpus
    scope, keys = list(corpus.scope), list(corpus.keys)
    options = [c for c in queries.columns if c not in ("query_id", "query", "limit", "match", "groups")]
    for column in options:
        field = "timestamp" if column == "since" else _ENDS.get(column, (column if column in _EQUALITY else None,))[0]
        if field not in corpus.filterable:
            raise ValueError(f"{column} is no query column for {corpus.name}")
    asked = queries
    if "since" in options:
        asked = asked.withColumn("since", since_bound(F.col("since"), F.lit(now) if now else F.now()))
    asked = asked.withColumnsRenamed({c: f"q_{c}" for c in options})

    clauses = query_clauses(asked.drop("limit"), match)
    limit = F.col("limit") if "limit" in queries.columns else F.lit(None).cast("int")
    wanted = F.least(F.greatest(F.coalesce(limit, F.lit(DEFAULT_LIMIT)), F.lit(1)), F.lit(MAX_LIMIT))
    asked_for = queries.select("query_id", "query", wanted.alias("wanted"))
    # How large the clauses and the hits can be at most, and whether there are
    # phrases and groups: decides the join strategies below.
    size = clauses.agg(
        F.coalesce(F.sum(F.octet_length("term") + _CLAUSE_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("width"), F.lit(1)).alias("width"),
        F.coalesce(F.max("group_id"), F.lit(0)).alias("last_group"),
        *([F.count_if(F.col("q_repo").isNull()).alias("open")] if "repo" in options else []),
    ).first()
    one_scope = not scope or ("repo" in options and size["open"] == 0)
    # a clause term has at most one row per scope it is asked in
    n_scopes = 1 if one_scope else index.count_scopes()
    small_clauses = n_scopes is not None and size["bytes"] * n_scopes <= BROADCAST_BYTES
    small_hits = (asked_for.agg(F.sum("wanted")).first()[0] or 0) * _HIT_BYTES <= BROADCAST_BYTES

    weighted = _weighted(index, clauses)
    on = ["term"]

    def meet(rows: DataFrame, part: DataFrame) -> DataFrame:
        part = part.withColumnsRenamed({f"in_{c}": c for c in scope})
        if small_clauses:
            joined = rows.join(F.broadcast(part), [*scope, *on])
        else:
            joined = salted_join(rows, part, [*scope, *on], keys)
        return joined.filter(all_of(_conditions(options)))

    rows = index.postings()
    filter_columns = ["timestamp" if c == "since" else _ENDS[c][0] if c in _ENDS else c for c in options]
    base = list(dict.fromkeys([*keys, *filter_columns, *on, "tf", "dl"]))
    groups = ["query_id", "groups_needed", "group_id", "n_needed"]
    clause_keys = [*groups, *keys, "clause_id"]
    hits = meet(rows.select(*base), weighted.filter("width = 1")).select(
        *clause_keys, "idf", "tf", "dl", "avg_dl"
    )
    if size["width"] > 1:
        with_positions = rows.select(*base, "positions")
        if small_clauses:
            phrased = [asked.filter("width > 1") for asked in (clauses, weighted)]
            terms = phrased[0].select("term").distinct()
            complete = _phrases_of_documents(with_positions, terms, phrased[1], corpus, groups, options, filter_columns)
        else:
            parts = meet(with_positions, weighted.filter("width > 1")).withColumn(
                "starts", F.expr("transform(positions, p -> p - offset)")
            )
            # all terms of one clause in one document: at most a query's length
            phrases = parts.groupBy(*clause_keys).agg(
                F.sum("idf").alias("idf"),
                F.collect_list("starts").alias("starts"),
                F.first("dl").alias("dl"),
                F.first("avg_dl").alias("avg_dl"),
                F.first("width").alias("width"),
            )
            complete = phrases.filter(F.size("starts") == F.col("width"))
        common = F.aggregate(
            F.slice("starts", 2, F.size("starts") - 1), F.get("starts", F.lit(0)), F.array_intersect
        )
        found = computed_once(complete, tf=F.size(common)).filter("tf > 0")
        hits = hits.unionByName(found.select(*hits.columns))

    gain = F.col("idf") * bm25.weight(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    if size["last_group"]:  # both sums below need a query's document in one place
        hits = hits.repartition("query_id", *keys)
    satisfied = (
        hits.groupBy(*groups, *keys)
        .agg(F.sum(gain).alias("gain"), F.count("*").alias("n_found"))
        .filter(F.col("n_found") >= F.col("n_needed"))
    )
    if size["last_group"]:
        satisfied = (
            satisfied.groupBy("query_id", "groups_needed", *keys)
            .agg(F.sum("gain").alias("gain"), F.count("*").alias("n_groups"))
            .filter(F.col("n_groups") >= F.col("groups_needed"))
        )
    scored = satisfied.select("query_id", *keys, bm25.reported(F.col("gain")).alias("score"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    top = scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= MAX_LIMIT)
    top = top.join(asked_for.select("query_id", "wanted"), "query_id").filter(F.col("rank") <= F.col("wanted")).drop("wanted")
    full = index.with_documents(top, hits_bounded=small_hits).join(asked_for.select("query_id", "query"), "query_id")
    return present(full, corpus, F.col("query"), "query_id", "rank")
