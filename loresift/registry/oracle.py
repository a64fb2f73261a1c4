"""The named queries in DuckDB's SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

# BM25 parameters and snippet widths.
K1, B = 1.2, 0.75
TALK_WIDTH, CODE_WIDTH = 140, 160

TOKENS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"

TALK = """
docs AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, 'srv/log/p' || (conv_id % 5) AS project, role AS event_role,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS at,
         '/t/-srv-log-p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file_path,
         turn AS event_index, text, '' AS scope
  FROM conversations WHERE role IN ('user', 'assistant'))
"""

CODE = """
docs AS (
  SELECT source AS repo, 'development' AS branch, 'unknown' AS commit_sha, source || '/' || doc_id || '.txt' AS file_path,
         lang AS language, text, CAST(strlen(text) AS BIGINT) AS size_bytes, 0 AS event_index, source AS scope, doc_id
  FROM documents)
"""


def _tokens(text: str = "text") -> str:
    return TOKENS.format(text=text)


def _index(docs: str) -> str:
    """CTEs: tokens with positions, lengths, frequencies and statistics per scope."""
    return f"""{docs},
    toks AS (SELECT scope, file_path, event_index, {_tokens()} AS t FROM docs),
    lens AS (SELECT scope, file_path, event_index, len(t) AS dl FROM toks),
    occ AS (SELECT scope, file_path, event_index, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks),
    tfs AS (SELECT scope, file_path, event_index, term, count(*) AS tf FROM occ GROUP BY ALL),
    dfs AS (SELECT scope, term, count(*) AS df FROM tfs GROUP BY ALL),
    stats AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY ALL),
    idfs AS (SELECT d.scope, d.term, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS idf
             FROM dfs d JOIN stats s ON d.scope = s.scope)"""


def _gain(tf: str) -> str:
    return f"{tf} * {K1 + 1} / ({tf} + {K1} * ({1 - B} + {B} * l.dl / s.avgdl))"


def _clause_rows(clauses: list[tuple[int, list[str]]]) -> str:
    """CTE ``found``: per document and clause its score. A clause is (group, terms)."""
    parts = []
    for number, (group, terms) in enumerate(clauses):
        if len(terms) == 1:
            hits = f"SELECT scope, file_path, event_index, tf FROM tfs WHERE term = '{terms[0]}'"
        else:
            joins = " ".join(
                f"JOIN occ o{i} ON o{i}.file_path = o0.file_path AND o{i}.event_index = o0.event_index "
                f"AND o{i}.scope = o0.scope AND o{i}.pos = o0.pos + {i} AND o{i}.term = '{t}'"
                for i, t in enumerate(terms)
                if i
            )
            hits = (
                f"SELECT o0.scope, o0.file_path, o0.event_index, count(*) AS tf FROM occ o0 {joins} "
                f"WHERE o0.term = '{terms[0]}' GROUP BY ALL"
            )
        weight = " + ".join(
            f"(SELECT idf FROM idfs i WHERE i.scope = h.scope AND i.term = '{t}')" for t in terms
        )
        parts.append(
            f"SELECT h.file_path, h.event_index, h.scope, {group} AS grp, {number} AS clause, "
            f"({weight}) * {_gain('h.tf')} AS gain FROM ({hits}) h "
            "JOIN lens l ON l.file_path = h.file_path AND l.event_index = h.event_index AND l.scope = h.scope "
            "JOIN stats s ON s.scope = h.scope"
        )
    return "found AS (" + " UNION ALL ".join(parts) + ")"


def _scored(groups: list[tuple[str, list[list[str]]]], match: str) -> str:
    """CTE ``scored``: documents that satisfy the groups, with their score."""
    clauses = [(g, terms) for g, (_, members) in enumerate(groups) for terms in members]
    need = " ".join(f"WHEN {g} THEN {len(members) if how == 'all' else 1}" for g, (how, members) in enumerate(groups))
    groups_needed = len(groups) if match == "all" else 1
    return f"""{_clause_rows(clauses)},
    by_group AS (SELECT scope, file_path, event_index, grp, sum(gain) AS gain FROM found
                 GROUP BY scope, file_path, event_index, grp HAVING count(*) >= CASE grp {need} END),
    scored AS (SELECT scope, file_path, event_index, round(sum(gain), 4) AS score FROM by_group
               GROUP BY scope, file_path, event_index HAVING count(*) >= {groups_needed})"""


def _snippet(text: str, needle: str, width: int) -> str:
    """Snippet around ``needle``, a SQL string in lower case."""
    start = f"greatest(greatest(instr(lower({text}), {needle}) - 1, 0) - {width // 2}, 0)"
    cut = f"regexp_replace(substr({text}, {start} + 1, {width}), '^\\s+|\\s+$', '', 'g')"
    before = f"CASE WHEN {start} > 0 THEN '…' ELSE '' END"
    after = f"CASE WHEN {start} + {width} < length({text}) THEN '…' ELSE '' END"
    return f"regexp_replace({before} || {cut} || {after}, '\\s+', ' ', 'g')"


AT = "strftime(d.at, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp"


def _talk_search(groups, first: str, match: str = "all", limit: int = 10, where: str = "TRUE") -> str:
    return f"""
    WITH {_index(TALK)}, {_scored(groups, match)}
    SELECT d.session_id, d.project, d.event_role, {AT}, d.file_path, d.event_index,
           {_snippet('d.text', f"'{first}'", TALK_WIDTH)} AS snippet, x.score
    FROM scored x JOIN docs d ON d.file_path = x.file_path AND d.event_index = x.event_index
    WHERE {where} ORDER BY x.score DESC, d.file_path, d.event_index LIMIT {limit}"""


def _code_search(groups, first: str, limit: int = 10, where: str = "TRUE") -> str:
    return f"""
    WITH {_index(CODE)}, {_scored(groups, 'all')}
    SELECT d.repo, d.branch, d.commit_sha, d.file_path, d.language, d.size_bytes,
           {_snippet('d.text', f"'{first}'", CODE_WIDTH)} AS snippet, x.score
    FROM scored x JOIN docs d ON d.file_path = x.file_path AND d.scope = x.scope
    WHERE {where} ORDER BY x.score DESC, d.repo, d.branch, d.file_path LIMIT {limit}"""


def _any(*words: str):
    return [("any", [[w] for w in words])]


def _all(*words: str):
    return [("all", [[w] for w in words])]


ANY_GROUPS = _any("the", "aning", "als")
CODE_GROUPS = _any("that", "estion", "ndat")
BOOL_GROUPS = [("any", [["the"], ["of", "the"]]), ("any", [["aning"], ["als"]])]


def _split(text: str) -> str:
    """Identifier splitting as four replacements, one per rule."""
    steps = [
        r"(\A\p{Lu}|\p{Lu}\p{Lu})(\p{Lu}\p{Ll})",
        r"(\p{Ll})(\p{Lu})",
        r"([0-9])(\p{L})",
        r"(\p{L})([0-9])",
    ]
    for step in steps:
        text = rf"regexp_replace({text}, '{step}', '\1 \2', 'g')"
    return text


def _batch(docs: str, asked: str, conditions: str, hit: str, keys: str, width: int) -> str:
    """Queries of a table: any of their words, compound words as adjacent terms."""
    return rf"""
    WITH {_index(docs)}, asked AS ({asked}),
    words AS (SELECT query_id, generate_subscripts(w, 1) AS clause, unnest(w) AS word
              FROM (SELECT query_id, regexp_split_to_array(query, '\s+') AS w FROM asked)),
    clauses AS (SELECT * FROM (SELECT query_id, clause, {_tokens('word')} AS t FROM words) WHERE len(t) > 0),
    terms AS (SELECT query_id, clause, len(t) AS width, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off FROM clauses),
    starts AS (SELECT q.query_id, q.clause, q.width, o.scope, o.file_path, o.event_index, o.pos - q.off AS start
               FROM terms q JOIN occ o ON o.term = q.term
               GROUP BY ALL HAVING count(DISTINCT q.off) = q.width),
    weights AS (SELECT q.query_id, q.clause, i.scope, sum(i.idf) AS idf FROM terms q JOIN idfs i ON i.term = q.term GROUP BY ALL),
    hits AS (SELECT query_id, clause, scope, file_path, event_index, count(*) AS tf FROM starts GROUP BY ALL),
    gains AS (SELECT h.query_id, h.scope, h.file_path, h.event_index,
                     round(sum(w.idf * {_gain('h.tf')}), 4) AS score
              FROM hits h JOIN weights w ON w.query_id = h.query_id AND w.clause = h.clause AND w.scope = h.scope
              JOIN lens l ON l.file_path = h.file_path AND l.event_index = h.event_index AND l.scope = h.scope
              JOIN stats s ON s.scope = h.scope GROUP BY h.query_id, h.scope, h.file_path, h.event_index),
    ranked AS (SELECT a.query, a.query_id, g.score, a.max_hits, d.*,
                      row_number() OVER (PARTITION BY a.query_id ORDER BY g.score DESC, {keys}) AS rank
               FROM gains g JOIN asked a ON a.query_id = g.query_id
               JOIN docs d ON d.file_path = g.file_path AND d.event_index = g.event_index AND d.scope = g.scope
               WHERE {conditions})
    SELECT d.query_id, d.rank, {hit},
           {_snippet('d.text', "lower(regexp_extract(d.query, '[^ ]+'))", width)} AS snippet, d.score
    FROM ranked d WHERE d.rank <= d.max_hits"""


ASKED = "SELECT item_id AS query_id, text AS query, 10 AS max_hits FROM benchmark"
ASKED_NARROW = rf"""
  SELECT query_id, query || ' ' || replace(query, ' ', '-') AS query,
         CASE WHEN query_id % 2 = 0 THEN 'srv/log/p' || (query_id % 5) END AS project,
         CASE WHEN query_id % 3 = 0 THEN TIMESTAMP '2024-01-02 12:00:00' END AS since,
         greatest(query_id % 20, 1) AS max_hits FROM ({ASKED})"""
ASKED_REPO = f"SELECT *, 'src' || (query_id % 20) AS repo FROM ({ASKED})"

TALK_HIT = f"d.session_id, d.project, d.event_role, {AT}, d.file_path, d.event_index"
CODE_HIT = "d.repo, d.branch, d.commit_sha, d.file_path, d.language, d.size_bytes"

PATHS = """
paths AS (
  SELECT doc_id, CAST(CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 23 = 0 THEN 1000001 ELSE strlen(text) END AS BIGINT) AS size_bytes,
    source || '/' ||
    CASE WHEN doc_id % 11 = 0 THEN '.hidden/' WHEN doc_id % 13 = 0 THEN 'node_modules/lib/'
         WHEN doc_id % 17 = 0 THEN 'src/build/' ELSE 'src/' END ||
    CASE WHEN doc_id % 7 = 0 THEN (['Makefile', 'Dockerfile', 'README', '.bashrc', 'justfile'])[doc_id % 5 + 1]
         ELSE 'f' || doc_id || '.' || (['rs', 'py', 'tsx', 'PNG', 'lock', 'md', 'jsonc', 'tar.gz', 'weird', 'h'])[doc_id % 10 + 1]
    END AS rel_path
  FROM documents),
named AS (SELECT *, split_part(rel_path, '/', -1) AS name FROM paths),
typed AS (SELECT *, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN lower(split_part(name, '.', -1)) ELSE '' END AS extension FROM named)
"""

LANGUAGE = """
CASE extension WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'md' THEN 'markdown'
  WHEN 'jsonc' THEN 'json' WHEN 'h' THEN 'c'
  WHEN '' THEN CASE lower(name) WHEN 'dockerfile' THEN 'dockerfile' WHEN 'makefile' THEN 'make'
    WHEN 'justfile' THEN 'just' ELSE 'other' END
  ELSE 'other' END
"""

# base folder, precedence, depth, line, pattern on the path below the base, negated, folders only
IGNORE = r"""
rules(base, precedence, depth, seq, pattern, negated, dir_only) AS (VALUES
  ('', 2, 0, 0, '(^|/)node_modules$', FALSE, TRUE),
  ('', 2, 0, 1, '(^|/)[^/]*\.lock$', FALSE, FALSE),
  ('', 2, 0, 3, '(^|/)build$', FALSE, TRUE),
  ('', 2, 0, 4, '^src1/src/build$', TRUE, TRUE),
  ('src2', 2, 1, 0, '(^|/)[^/]*\.md$', FALSE, FALSE),
  ('src2', 2, 1, 1, '(^|/)f2[^/]*\.md$', TRUE, FALSE),
  ('src2', 2, 1, 2, '^src/[^/]*\.rs$', FALSE, FALSE),
  ('', 3, 0, 0, '(^|/)[^/]*\.weird$', FALSE, FALSE),
  ('', 3, 0, 1, '^src4/(.*/)?f4[^/]\.lock$', TRUE, FALSE)),
nodes AS (SELECT DISTINCT rel_path, array_to_string(parts[1:n], '/') AS node, n < len(parts) AS is_dir
  FROM (SELECT rel_path, string_split(rel_path, '/') AS parts, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS n FROM paths)),
verdicts AS (SELECT n.rel_path, n.node, arg_max(r.negated, r.precedence * 1000000 + r.depth * 1000 + r.seq) AS negated
  FROM nodes n JOIN rules r ON (r.base = '' OR starts_with(n.node, r.base || '/')) AND (n.is_dir OR NOT r.dir_only)
   AND regexp_matches(CASE WHEN r.base = '' THEN n.node ELSE substr(n.node, length(r.base) + 2) END, r.pattern)
  GROUP BY n.rel_path, n.node)
"""

REVISED_TALK = """
docs AS (
  SELECT '/t/-srv-log-p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file_path, turn AS event_index,
         CASE WHEN conv_id % 4 = 1 THEN text || ' revised' ELSE text END AS text, '' AS scope
  FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 4 <> 3)
"""

REVISED_CODE = """
docs AS (
  SELECT source || '/' || doc_id || '.txt' AS file_path, 0 AS event_index, source AS scope,
         CASE WHEN source = 'src3' THEN text || ' revised' ELSE text END AS text
  FROM documents WHERE source <> 'src3' OR doc_id % 2 = 1)
"""

CHANGES = """
changes AS (
  SELECT '/t/p/' || user_id || '.jsonl' AS file_path, CAST(ts AS TIMESTAMP) AS ts
  FROM events WHERE event_type <> 'click' AND user_id % 10 <> 0),
steps AS (SELECT *, lag(ts) OVER (PARTITION BY file_path ORDER BY ts) AS previous FROM changes),
numbered AS (SELECT *, sum(CASE WHEN previous IS NULL OR ts - previous >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
               OVER (PARTITION BY file_path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM steps),
bursts AS (SELECT file_path, min(ts) AS first_change, max(ts) AS last_change, count(*) AS n_changes
           FROM numbered GROUP BY file_path, burst)
"""

CONTENT = """
CASE WHEN turn % 3 = 1 THEN text || chr(10) || '[tool: Read]' || chr(10) || '{"line":' || turn || ',"path":"/a b"}'
     WHEN turn % 3 = 2 THEN text || chr(10) || 'done' ELSE text END
"""

ASKED_GROUPS = r"""
  SELECT item_id AS query_id, text AS query, regexp_split_to_array(text, '\s+') AS w,
         CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END AS groups_needed, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS second_needed,
         CASE WHEN item_id % 5 = 0 THEN 1 END AS event_index_min
  FROM benchmark"""


def _batch_groups() -> str:
    """Per query a group of a phrase or a word, and one of two words."""
    return rf"""
    WITH {_index(TALK)}, asked AS ({ASKED_GROUPS}),
    pieces AS (SELECT query_id, 0 AS grp, 0 AS clause, {_tokens("w[1] || ' ' || w[2]")} AS t FROM asked
               UNION ALL SELECT query_id, 0, 1, {_tokens('w[3]')} FROM asked
               UNION ALL SELECT query_id, 1, 2, {_tokens('w[4]')} FROM asked
               UNION ALL SELECT query_id, 1, 3, {_tokens('w[5]')} FROM asked),
    terms AS (SELECT query_id, grp, clause, len(t) AS width, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off
              FROM pieces WHERE len(t) > 0),
    sizes AS (SELECT query_id, grp, count(DISTINCT clause) AS n FROM terms GROUP BY ALL),
    starts AS (SELECT q.query_id, q.grp, q.clause, q.width, o.file_path, o.event_index, o.pos - q.off AS start
               FROM terms q JOIN occ o ON o.term = q.term GROUP BY ALL HAVING count(DISTINCT q.off) = q.width),
    weights AS (SELECT query_id, clause, sum(idf) AS idf FROM terms JOIN idfs USING (term) GROUP BY ALL),
    hits AS (SELECT query_id, grp, clause, file_path, event_index, count(*) AS tf FROM starts GROUP BY ALL),
    by_group AS (SELECT h.query_id, h.grp, h.file_path, h.event_index, sum(w.idf * {_gain('h.tf')}) AS gain, count(*) AS n_found
                 FROM hits h JOIN weights w USING (query_id, clause)
                 JOIN lens l ON l.file_path = h.file_path AND l.event_index = h.event_index, stats s GROUP BY ALL),
    held AS (SELECT g.* FROM by_group g JOIN asked a USING (query_id) JOIN sizes z USING (query_id, grp)
             WHERE n_found >= CASE WHEN grp = 1 AND second_needed = 2 THEN z.n ELSE 1 END),
    gains AS (SELECT query_id, file_path, event_index, round(sum(gain), 4) AS score, count(*) AS n_groups FROM held GROUP BY ALL),
    ranked AS (SELECT a.query, a.query_id, g.score, d.*,
                      row_number() OVER (PARTITION BY a.query_id ORDER BY g.score DESC, d.file_path, d.event_index) AS rank
               FROM gains g JOIN asked a USING (query_id) JOIN docs d ON d.file_path = g.file_path AND d.event_index = g.event_index
               WHERE g.n_groups >= least(a.groups_needed, (SELECT count(*) FROM sizes z WHERE z.query_id = a.query_id))
                 AND (a.event_index_min IS NULL OR d.event_index >= a.event_index_min))
    SELECT d.query_id, d.rank, {TALK_HIT}, {_snippet('d.text', "lower(regexp_extract(d.query, '[^ ]+'))", TALK_WIDTH)} AS snippet, d.score
    FROM ranked d WHERE d.rank <= 10"""


REFRESHED = """
kept AS (SELECT *, '-docs-' || source || '/' || doc_id || '.jsonl' AS file_path FROM documents WHERE doc_id % 6 <> 0)
"""
REFRESHED_DOCS = f"""
WITH {REFRESHED}
SELECT file_path, CAST(0 AS BIGINT) AS event_index, 'docs/' || source AS project,
       md5(CASE WHEN doc_id % 4 = 0 THEN text || ' revised' ELSE text END) AS text_md5 FROM kept WHERE doc_id % 7 <> 0
UNION ALL SELECT file_path, 2, 'docs/' || source, md5(lang) FROM kept WHERE doc_id % 7 <> 0"""

ORACLE = {
    "transcript_extract": f"""
    SELECT CAST(conv_id AS VARCHAR) AS session_id, 'srv/log/p' || (conv_id % 5) AS project,
           CASE WHEN turn % 3 = 2 THEN 'attachment' ELSE role END AS event_role, '/w' AS cwd, 'main' AS git_branch,
           '/t/-srv-log-p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file_path, turn AS event_index,
           {CONTENT} AS text,
           strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS at
    FROM conversations WHERE role <> 'system'""",
    "project_label": """
    SELECT conv_id, turn, '/t/-srv-log-p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file_path,
           'srv/log/p' || (conv_id % 5) AS project FROM conversations""",
    "language_label": f"WITH {PATHS} SELECT doc_id, rel_path, extension, {LANGUAGE} AS language FROM typed",
    "path_gates": f"""
    WITH {PATHS} SELECT doc_id, rel_path, size_bytes FROM typed
    WHERE size_bytes BETWEEN 1 AND 1000000 AND extension NOT IN ('png', 'lock', 'gz')
      AND NOT starts_with(rel_path, '.') AND strpos(rel_path, '/.') = 0""",
    "ignore_filter": f"""
    WITH {PATHS}, {IGNORE} SELECT doc_id, rel_path, size_bytes FROM paths
    WHERE rel_path NOT IN (SELECT rel_path FROM verdicts WHERE NOT negated)""",
    "identifier_split": f"""
    WITH every AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || p_partkey, p_brand FROM part
                   UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)
    SELECT id, {_split('t')} AS split_text FROM every""",
    "identifier_expand": f"""
    SELECT doc_id, CASE WHEN s <> text THEN text || chr(10) || s ELSE text END AS expanded
    FROM (SELECT doc_id, text, {_split('text')} AS s FROM documents)""",
    "scan_jsonl": r"""
    WITH cut AS (SELECT source || '/' || doc_id || '.jsonl' AS file_path, string_split(text, chr(10)) AS parts FROM documents),
    numbered AS (SELECT file_path, generate_subscripts(parts, 1) - 1 AS event_index, unnest(parts) AS part FROM cut)
    SELECT file_path, event_index, regexp_replace(part, '\r$', '') AS line FROM numbered WHERE regexp_matches(part, '\S')""",
    "scan_tree": f"""
    WITH files AS (
      SELECT source || '/' || CASE WHEN doc_id % 3 = 0 THEN '_' WHEN doc_id % 11 = 0 THEN '.' ELSE 'f' END || doc_id || '.' ||
             (['rs', 'py', 'tsx', 'PNG', 'lock', 'md', 'jsonc', 'tar.gz', 'weird', 'h'])[doc_id % 10 + 1] AS file_path,
             doc_id, text, {_split('text')} AS s FROM documents)
    SELECT 'tree' AS repo, 'development' AS branch, file_path,
           (['rust', 'python', 'typescript', '', '', 'markdown', 'json', '', 'other', 'c'])[doc_id % 10 + 1] AS language,
           CAST(strlen(text) AS BIGINT) AS size_bytes,
           md5(CASE WHEN s <> text THEN text || chr(10) || s ELSE text END) AS content_md5
    FROM files WHERE doc_id % 10 NOT IN (3, 4, 7) AND (doc_id % 3 = 0 OR doc_id % 11 <> 0)
      AND strlen(text) BETWEEN 1 AND 1000000""",
    "postings": f"""
    WITH {_index(CODE)}, lists AS (SELECT scope, file_path, event_index, term, count(*) AS tf,
        string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM occ GROUP BY ALL)
    SELECT p.scope AS repo, p.file_path, p.term, CAST(p.tf AS INTEGER) AS tf, CAST(l.dl AS INTEGER) AS dl, p.positions
    FROM lists p JOIN lens l ON l.file_path = p.file_path AND l.scope = p.scope""",
    "dictionary": f"WITH {_index(CODE)} SELECT scope AS repo, term, df FROM dfs",
    "corpus_stats": f"""
    WITH {_index(CODE)} SELECT scope AS repo, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS sum_dl FROM lens GROUP BY scope""",
    "stored_dictionary": f"WITH {_index(TALK)} SELECT term, df FROM dfs",
    "search_any": _talk_search(ANY_GROUPS, "the"),
    "search_all": _talk_search(_all("the", "aning"), "the"),
    "search_phrase": _talk_search([("all", [["of", "the"]])], "of"),
    "search_compound": _talk_search([("any", [["the"], ["of", "the"]])], "the"),
    "search_bool": _talk_search(BOOL_GROUPS, "the"),
    "search_text_syntax": _talk_search(BOOL_GROUPS, "the"),
    "search_range_open": _talk_search(ANY_GROUPS, "the", limit=20, where="d.event_index BETWEEN 1 AND 2"),
    "search_bool_any": _talk_search(
        [("all", [["the"], ["aning"]]), ("all", [["als"], ["der"]])], "the", match="any", limit=25
    ),
    "search_since": _talk_search(ANY_GROUPS, "the", limit=20, where="d.at >= TIMESTAMP '2024-01-03'"),
    "search_range": _talk_search(ANY_GROUPS, "the", limit=20, where="d.event_index BETWEEN 1 AND 2"),
    "search_project": _talk_search(ANY_GROUPS, "the", where="d.project = 'srv/log/p1'"),
    "search_keyword": _talk_search(ANY_GROUPS, "the", limit=100, where="d.event_role = 'assistant'"),
    "search_code": _code_search(CODE_GROUPS, "that", limit=30),
    "search_repo_language": _code_search(CODE_GROUPS, "that", where="d.repo = 'src3' AND d.language = 'en'"),
    "stored_search": _talk_search(ANY_GROUPS, "the"),
    "stored_search_bool": _talk_search(BOOL_GROUPS, "the"),
    "stored_search_code": _code_search(CODE_GROUPS, "that", where="d.repo = 'src3' AND d.language = 'en'"),
    "batch_search": _batch(TALK, ASKED, "TRUE", TALK_HIT, "d.file_path, d.event_index", TALK_WIDTH),
    "batch_search_filtered": _batch(
        TALK,
        ASKED_NARROW,
        "(a.project IS NULL OR a.project = d.project) AND (a.since IS NULL OR d.at >= a.since)",
        TALK_HIT,
        "d.file_path, d.event_index",
        TALK_WIDTH,
    ),
    "batch_search_code": _batch(CODE, ASKED_REPO, "a.repo = d.repo", CODE_HIT, "d.repo, d.file_path", CODE_WIDTH),
    "stored_batch_search": _batch(TALK, ASKED, "TRUE", TALK_HIT, "d.file_path, d.event_index", TALK_WIDTH),
    "match_count": f"""
    SELECT count(*) AS n_matches FROM documents WHERE lang = 'en' AND list_has_any({_tokens()}, ['that', 'estion', 'ndat'])""",
    "snippet_transcript": f"WITH {TALK} SELECT file_path, event_index, {_snippet('text', chr(39) + 'the' + chr(39), TALK_WIDTH)} AS snippet FROM docs",
    "snippet_code": f"WITH {CODE} SELECT file_path, {_snippet('text', chr(39) + 'that' + chr(39), CODE_WIDTH)} AS snippet FROM docs",
    "since_values": """
    SELECT event_id,
      CASE WHEN event_id % 2 = 0 THEN (event_id % 100) || (['s', 'm', 'h', 'd', 'w'])[event_id % 5 + 1]
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00' END AS since,
      strftime(CASE WHEN event_id % 2 = 0
        THEN TIMESTAMP '2024-01-31' - to_seconds((event_id % 100) * ([1, 60, 3600, 86400, 604800])[event_id % 5 + 1])
        ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS bound
    FROM events""",
    "index_summary": """
    SELECT count(*) AS n_documents, count(DISTINCT source || '/' || doc_id) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
    FROM documents""",
    "doc_count": "SELECT count(*) AS n_documents FROM documents",
    "default_repo": "SELECT max(source) AS repo FROM documents",
    "batch_search_bool": _batch_groups(),
    "replace_thrice": f"WITH {_index(REVISED_TALK)} SELECT term, df FROM dfs",
    "compact_index": f"""
    WITH {REVISED_TALK} SELECT file_path, event_index, md5(text) AS text_md5, count(*) OVER () AS n_docs FROM docs""",
    "pinned_reader": f"""
    WITH {TALK} SELECT 'pinned' AS reader, count(*) AS n_documents FROM docs
    UNION ALL SELECT 'current', count(*) FROM docs WHERE CAST(session_id AS BIGINT) % 2 = 0""",
    "index_refresh": REFRESHED_DOCS,
    "stream_bootstrap_follow": REFRESHED_DOCS,
    "transcript_summary": f"""
    WITH {REFRESHED} SELECT CAST(2 * count(*) FILTER (doc_id % 7 <> 0) AS BIGINT) AS n_documents, count(*) AS n_files FROM kept""",
    "hits_json_rows": _talk_search(ANY_GROUPS, "the"),
    "repo_list": "SELECT DISTINCT source AS repo FROM documents ORDER BY repo",
    "listing_transcripts": f"""
    WITH hits AS ({_talk_search(ANY_GROUPS, "the")})
    SELECT CAST(row_number() OVER (ORDER BY score DESC, file_path, event_index) AS INTEGER) AS rank,
      lpad(CAST(row_number() OVER (ORDER BY score DESC, file_path, event_index) AS VARCHAR), 2, ' ') || '. [' || timestamp || '] ' || project
      || ' ' || session_id || ' (' || event_role || ')' || chr(10) || '    ' || snippet || chr(10) || '    ' || file_path AS listing
    FROM hits""",
    "listing_code": f"""
    WITH hits AS ({_code_search(CODE_GROUPS, "that", limit=30)})
    SELECT CAST(row_number() OVER (ORDER BY score DESC, repo, branch, file_path) AS INTEGER) AS rank,
      lpad(CAST(row_number() OVER (ORDER BY score DESC, repo, branch, file_path) AS VARCHAR), 2, ' ') || '. [' || repo || '/' || branch || '] '
      || file_path || ' (' || language || ')' || chr(10) || '    ' || snippet AS listing
    FROM hits""",
    "replace_file": f"WITH {_index(REVISED_TALK)} SELECT term, df FROM dfs",
    "replace_branch": f"WITH {_index(REVISED_CODE)} SELECT scope AS repo, term, df FROM dfs",
    "prune_files": f"""
    WITH {TALK} SELECT file_path, count(*) AS n_events FROM docs WHERE CAST(session_id AS BIGINT) % 3 <> 0 GROUP BY file_path""",
    "change_detect": """
    SELECT DISTINCT '/t/-srv-log-p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file_path,
      CASE WHEN conv_id % 5 = 0 THEN 'created' WHEN conv_id % 7 = 0 THEN 'removed' ELSE 'modified' END AS change
    FROM conversations
    WHERE (conv_id % 5 = 0 AND conv_id % 7 <> 0) OR (conv_id % 5 <> 0 AND (conv_id % 7 = 0 OR conv_id % 3 = 0))""",
    "burst_batch": f"WITH {CHANGES} SELECT file_path, first_change, last_change, n_changes FROM bursts",
    "stream_debounce": f"""
    WITH {CHANGES} SELECT file_path, first_change, last_change, n_changes FROM bursts
    WHERE last_change + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 SECOND FROM changes)""",
    "stream_follow": f"""
    WITH {CHANGES} SELECT file_path, min(ts) AS first_change, max(ts) AS last_change, count(*) AS n_changes FROM changes GROUP BY file_path""",
    "stream_upsert": """
    WITH kept AS (SELECT *, '/t/-docs-' || source || '/' || doc_id || '.jsonl' AS file_path FROM documents WHERE doc_id % 5 <> 0)
    SELECT file_path, CAST(0 AS BIGINT) AS event_index, 'docs/' || source AS project,
           md5(CASE WHEN doc_id % 3 = 0 THEN text || ' revised' ELSE text END) AS text_md5 FROM kept
    UNION ALL SELECT file_path, 2, 'docs/' || source, md5(lang) FROM kept WHERE doc_id % 3 <> 0""",
}
