"""Queries over conversations: prefix trie and structure repair, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import conversation_repair, prefix_trie
from parlance.llm.registry import query

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
BLOCK = 20  # neighbouring conversations that share the head of the first


def crc32_sql(string: str) -> str:
    """Checksum of an ASCII string, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split({string}, ''), lambda x: ord(x)::BIGINT),
        lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
            lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)),
        4294967295))"""


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their block."""
    block = Window.partitionBy(F.col("conv_id") - F.col("conv_id") % BLOCK)
    first = F.max(F.when(F.col("conv_id") % BLOCK == 0, F.slice("turns", 1, 3))).over(block)
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    none = F.slice("turns", 1, 0)
    return convs.withColumn("head", F.coalesce(first, none)).select(
        "conv_id",
        F.concat(
            F.slice("head", F.lit(1), head.cast("int")),
            F.slice("turns", (head + 1).cast("int"), F.size("turns")),
        ).alias("turns"),
    )


@query(
    "op12_prefix_trie",
    rf"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':'
                          || coalesce(text, ''))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
    made AS (
        SELECT ids.conv_id, 0 AS part, pos, role, text
        FROM ids JOIN turns ON turns.conv_id = ids.conv_id - ids.conv_id % {BLOCK} AND pos <= h
        UNION ALL
        SELECT conv_id, 1, pos, role, text FROM ids JOIN turns USING (conv_id) WHERE pos > h),
    seqs AS (
        SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos)
                                 FILTER (part IS NOT NULL), []) AS s
        FROM ids LEFT JOIN made USING (conv_id) GROUP BY conv_id),
    steps AS (SELECT conv_id, s[1:d] AS path, d, len(s) = d AS ended
              FROM seqs, unnest(range(len(s) + 1)) AS r(d)),
    nodes AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), ''))
                   AS ends_sha256,
               CASE WHEN d = 0 THEN 0 ELSE
                    len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words
        FROM steps GROUP BY path, d),
    counted AS (
        SELECT a.path, a.d, a.conv_id, a.n_convs, a.ends_sha256, a.words, p.conv_id AS parent_conv_id,
               (SELECT count(*) FROM nodes c WHERE c.d = a.d + 1 AND c.path[1:a.d] = a.path) AS n_children
        FROM nodes a LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.path = a.path[1:a.d - 1])
    SELECT a.conv_id, a.d::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children,
           sum((b.n_children = 0)::INT)::BIGINT AS n_leaves,
           sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, a.ends_sha256
    FROM counted a JOIN counted b ON b.d >= a.d AND b.path[1:a.d] = a.path
    GROUP BY a.path, a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
    """,
)
def op12(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    trie = prefix_trie.prefix_trie(rebuilt(prefix_trie.conversations_of(given)))
    ends = prefix_trie.digest_lists(trie.ends)
    return trie.nodes.join(ends, "path", "left").fillna(EMPTY_SHA256, ["ends_sha256"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256",
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut off, repeated and given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    read = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.filter("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("time"),
    ).drop("time")


def _sql_edit(value: str, cost: int, initial: str) -> str:
    """A plan, ten digits of cost and then its audit, with one more edit before it."""
    return f"lpad((({value})[1:10]::INT + {cost})::VARCHAR, 10, '0') || '{initial}' || ({value})[11:]"


def _sql_state(state: str, moves: dict[str, str]) -> str:
    """Least plan from a state on by an edit of the row, before any insertion."""
    cut = "(CASE WHEN r.f = 't' THEN 3 ELSE 0 END)"
    ways = [_sql_edit(state, 4, "D")]
    for letter, then in moves.items():
        ways.append(f"CASE WHEN r.f NOT IN ('b', 'd') AND r.x = '{letter}' THEN {_sql_edit(then, cut, 'K')} ELSE '~' END")
        if letter != "s":
            ways.append(f"CASE WHEN r.f NOT IN ('b', 'd') THEN {_sql_edit(then, f'3 + {cut}', 'R')} ELSE '~' END")
    return f"least({', '.join(ways)})"


@query(
    "op13_conversation_repair",
    rf"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
        FROM conversations),
    hit AS (
        SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM given, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
    told AS (
        SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS time,
               CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS x
        FROM hit),
    r AS (
        SELECT conv_id, turn, role, text, x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time > 1) AS i,
               count(*) OVER (PARTITION BY conv_id) AS n,
               CASE WHEN said = '' THEN 'b' WHEN time > 1 THEN 'd'
                    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS f
        FROM told),
    dp AS (
        SELECT DISTINCT conv_id, n + 1 AS i, '0000000000' AS f0, '0000000006II' AS f1,
               '0000000003I' AS f2, '0000000000' AS f3
        FROM r
        UNION ALL
        SELECT conv_id, i, least(g0, {_sql_edit("h2", 3, "I")}), least(g1, {_sql_edit("h2", 3, "I")}), h2,
               least(g3, {_sql_edit("g2", 3, "I")})
        FROM (
            SELECT conv_id, i, g0, g1, g2, g3, least(g2, {_sql_edit("g3", 3, "I")}) AS h2
            FROM (
                SELECT dp.conv_id, r.i, {_sql_state("f0", {"s": "f1", "u": "f2"})} AS g0,
                       {_sql_state("f1", {"u": "f2"})} AS g1, {_sql_state("f2", {"a": "f3"})} AS g2,
                       {_sql_state("f3", {"u": "f2"})} AS g3
                FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i - 1))),
    planned AS (SELECT conv_id, f0[1:10]::BIGINT AS cost, f0[11:] AS audit FROM dp WHERE i = 1),
    edits AS (
        SELECT conv_id, p, audit[p] AS e,
               p - len(replace(translate(audit[1:p], 'KRD', ''), ' ', '')) AS row,
               len(translate(audit[1:p], 'D', '')) AS m, len(audit) - len(ltrim(audit, 'D')) + 1 AS lead,
               ltrim(audit, 'D')[1] AS opening
        FROM planned, unnest(range(1, len(audit) + 1)) AS u(p)),
    fixed AS (
        SELECT e.conv_id,
               sha256(string_agg(
                   (CASE WHEN e = 'K' THEN r.role WHEN (m - (opening = 'K' AND s.x = 's')::INT) % 2 = 1
                         THEN 'user' ELSE 'assistant' END)
                   || ':' || (CASE WHEN e = 'I' THEN '' ELSE r.text END), chr(10) ORDER BY p)) AS digest
        FROM edits e
        LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.row
        LEFT JOIN r s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.i = e.lead
        WHERE e <> 'D' GROUP BY e.conv_id),
    faults AS (
        SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
               count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
               count(*) FILTER (f = 't') AS truncated,
               count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
    SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           coalesce(digest, '{EMPTY_SHA256}') AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) g
    LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM g.conv_id
    LEFT JOIN planned ON planned.conv_id IS NOT DISTINCT FROM g.conv_id
    LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM g.conv_id
    """,
)
def op13(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    mended = conversation_repair.repair_conversations(damaged(given))
    lines = F.transform("repaired", lambda t: F.concat_ws(":", t["role"], t["text"]))
    mended = mended.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("edits", "repaired")
    all_ids = given.select(F.col("conv_id").alias("id")).distinct()
    joined = all_ids.join(mended, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.drop("conv_id").withColumnRenamed("id", "conv_id").fillna(
        {**zeros, "audit": "", "repaired_sha256": EMPTY_SHA256}
    )
