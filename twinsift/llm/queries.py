"""Queries over the operators of this subpackage, at production parameters, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.components import counting_edges, linked_groups
from twinsift.llm.incremental import clusters_of_history, duplicates_of_history
from twinsift.llm.knn import neighbour_pairs, similar_vectors
from twinsift.llm.leakage import leaked_items
from twinsift.llm.packing import CAPACITY, pack_texts
from twinsift.llm.quality import complete_rules, learn_prose_rules, prose_policy, rules_sql, text_statistics
from twinsift.llm.setjoin import record_sets, similar_set_pairs, similar_set_summary
from twinsift.llm.shared import Workspace, usable_hash
from twinsift.llm.survivor import SURVIVORS, VOTES, surviving_values, survivors_by_group, unpivot_media
from twinsift.operators.similarity import against_all
from twinsift.plans.oracle import greedy


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = similar_vectors(table(spark, folder, "images"), "image_id", ["phash", "dhash", "ahash"])
    return neighbour_pairs(near)


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its neighbours and distances."""
    return similar_vectors(table(spark, folder, "images"), "image_id", ["phash", "dhash", "ahash"])


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(asked, neighbours, reached): brute force for the records whose id is divisible by 20, against all; whether the graphs find 0.9 of their neighbours."""
    work = Workspace(spark, "recall")
    hashes = ["phash", "dhash", "ahash"]
    images = table(spark, folder, "images").where("image_id is not null")
    records = images.groupBy(F.col("image_id").alias("id")).agg(*[F.max(usable_hash(h)).alias(h) for h in hashes]).dropna()
    words = [F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"w{j}_{i}") for j, h in enumerate(hashes) for i in range(4)]
    rows = work.save(records.select("id", *words), "records")
    names = [c for c in rows.columns if c != "id"]
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in names])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a{c}"))) for c in names[1:]), F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"a{names[0]}"))))
    close = against_all(asked, rows, "id").where((F.col("id") != F.col("a")) & (apart <= 76)).select("a", "id", apart.alias("d"))
    best = close.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "id"))).where("r <= 5")
    found = p1_neighbours(spark, folder).select(F.col("id").alias("a"), F.col("neighbour").alias("id"), F.lit(1).alias("hit"))
    told = best.join(found, ["a", "id"], "left").select(F.lit(0).alias("asked"), F.lit(1).alias("neighbour"), F.coalesce("hit", F.lit(0)).alias("hit"))
    parts = asked.select(F.lit(1).alias("asked"), F.lit(0).alias("neighbour"), F.lit(0).alias("hit")).unionByName(told)
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "neighbour", "hit")])
    return sums.select("asked", F.col("neighbour").alias("neighbours"), (F.col("hit") * 10 >= F.col("neighbour") * 9).alias("reached"))


def video_sets(spark: SparkSession, folder: str) -> DataFrame:
    videos = table(spark, folder, "videos").select(F.col("video_id").alias("id"), "frame_hashes")
    known = table(spark, folder, "known_media").select(F.col("known_id").alias("id"), "frame_hashes")
    return record_sets(videos.unionByName(known), "id", "frame_hashes")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_set_pairs(video_sets(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return similar_set_summary(video_sets(spark, folder))


def p3_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    fields = unpivot_media(table(spark, folder, "images"), table(spark, folder, "videos"))
    return table(spark, folder, "dup_groups"), fields


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_values(*p3_rows(spark, folder), SURVIVORS).select("group_id", "field", "path")


def p3_golden(spark: SparkSession, folder: str) -> DataFrame:
    """One row per group, values elected by votes of trust and recency.

    A source is what a row's path promises: names in a format without loss are trusted more than others.
    """
    members, fields = p3_rows(spark, folder)
    lossless = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin("png", "bmp", "tif", "tiff")
    won = surviving_values(members, fields.withColumn("source", F.when(lossless, "lossless").otherwise("lossy")), VOTES, trust={"lossy": 0.6})
    return survivors_by_group(won, ["resolution", "file_size", "duration"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(counting_edges(table(spark, folder, "match_edges")))


def p6_rows(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates_of_history(*[table(spark, folder, t) for t in ("images", "videos", "known_media")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_rows(spark, folder).select("media", "record_id")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every duplicate and every accepted item near one, with the representative of its cluster."""
    rows = clusters_of_history(*[table(spark, folder, t) for t in ("images", "videos", "known_media")])
    return rows.select("record_id", "cluster_id")


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row about p7_packing: documents, and how many break a rule (more than their capacity in a container, gaps between pieces, cut though they fit, tokens lost)."""
    work = Workspace(spark, "packing-checks")
    pieces = work.save(p7_packing(spark, folder), "pieces")
    by_doc = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("stop"))
    docs = by_doc.agg(
        F.count("*").alias("documents"),
        F.count(F.when((F.col("n") > 1) & (F.col("tokens") <= CAPACITY), 1)).alias("cut_in_vain"),
        F.count(F.when(F.col("tokens") != F.col("stop"), 1)).alias("lost"),
    )
    line = Window.partitionBy("container_id").orderBy("offset_in_container")
    placed = pieces.where("container_id is not null").withColumn("gap", F.col("offset_in_container") != F.coalesce(F.lag(F.col("offset_in_container") + F.col("n_tokens")).over(line), F.lit(0)))
    held = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("gap"), 1)).alias("gaps"))
    packs = held.agg(
        F.count(F.when(F.col("tokens") > CAPACITY, 1)).alias("overfull"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count("*")).alias("unused_numbers"), (F.coalesce(F.sum("tokens"), F.lit(0)) * 100 >= F.count("*") * CAPACITY * 99).alias("well_filled"),
    )
    # two tables of one row each
    return docs.withColumn("one", F.lit(1)).join(packs.withColumn("one", F.lit(1)), "one").drop("one")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).select("doc_id", "item_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the number of places of the document that match."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id", "shared_runs")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    shares = ["mean_word_length", "symbol_share", "stop_line_share", "common_share"]
    return rows.withColumns({c: F.round(c, 6) for c in shares})


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents the learned rule list calls prose.

    The statistics are written once: learning and applying both read them.  Rules are
    learned on until they agree with the definition on all documents; if they cannot
    (without an example of prose nothing can be learned) the definition stands alone.
    """
    work = Workspace(spark, "quality")
    rows = work.save(text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words")), "statistics")
    rules = complete_rules(rows, prose_policy(), learn_prose_rules(rows, prose_policy()))
    return rows.where(F.expr(rules_sql(rules)) == "prose" if rules else prose_policy()).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p1_found, p1_neighbours, p1_recall, p2_found, p2_classes, p3_found, p3_golden, p5_found, p6_found, p6_clusters,
        p7_packing, p7_checks, p8_found, p8_report, p9_statistics, p9_found,
    ]
    return {f.__name__: f for f in found}


SETS = """
rows AS (SELECT video_id AS id, frame_hashes AS f FROM videos UNION ALL SELECT known_id, frame_hashes FROM known_media),
held AS (SELECT DISTINCT id, lower(trim(h, ' ')) AS h FROM (SELECT id, unnest(f) AS h FROM rows)
         WHERE regexp_full_match(lower(trim(h, ' ')), '[0-9a-f]{64}')),
sizes AS (SELECT id, count(*) AS n FROM held GROUP BY id HAVING count(*) >= 3),
sets AS (SELECT held.* FROM held JOIN sizes USING (id)),
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sets a JOIN sets b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a AS id_a, b AS id_b FROM both_ JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * k >= 3 * (x.n + y.n - k))
"""

MEDIA_FIELDS = """
long_rows AS (
  SELECT path, 'resolution' AS field, width::BIGINT * height::BIGINT AS value, scanned_at AS seen, 'images' AS source FROM images WHERE width > 0 AND height > 0
  UNION ALL SELECT path, 'resolution', width::BIGINT * height::BIGINT, scanned_at, 'videos' FROM videos WHERE width > 0 AND height > 0
  UNION ALL SELECT path, 'file_size', file_size, scanned_at, 'images' FROM images WHERE file_size > 0
  UNION ALL SELECT path, 'file_size', file_size, scanned_at, 'videos' FROM videos WHERE file_size > 0
  UNION ALL SELECT path, 'duration', duration, scanned_at, 'videos' FROM videos WHERE duration > 0 AND isfinite(duration)),
members AS (SELECT DISTINCT group_id, path FROM dup_groups WHERE group_id IS NOT NULL AND path IS NOT NULL),
joined AS (SELECT group_id, field, value::DOUBLE AS value, seen, source, path FROM members JOIN long_rows USING (path))
"""

WORDS = r"""
words AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '') AS w,
          list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS l FROM documents),
counts AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS n_word_chars,
  length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS n_symbols, len(l) AS n_lines,
  len(list_filter(l, lambda x: x[-1] IN ('.', '!', '?'))) AS n_stop_lines,
  len(list_filter(w, lambda x: list_contains(ws,
    lower(regexp_replace(regexp_replace(x, '^[^A-Za-z]+', ''), '[^A-Za-z]+$', ''))))) AS n_common FROM words, (SELECT list(word) AS ws FROM common_words))
"""


USABLE = "regexp_full_match(lower(trim(h, ' ')), '[0-9a-f]{64}')"
LEAKS = """
items AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(passage, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS t FROM eval_items WHERE item_id IS NOT NULL AND passage IS NOT NULL),
runs AS (SELECT DISTINCT item_id, k, array_to_string(t[s : s + k - 1], ' ') AS run FROM (SELECT item_id, t, least(len(t), 13) AS k, unnest(range(1, len(t) - least(len(t), 13) + 2)) AS s FROM items WHERE len(t) > 0)),
docs AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS t FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, k, s, array_to_string(t[s : s + k - 1], ' ') AS run FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS s FROM docs, (SELECT DISTINCT k FROM runs) WHERE len(t) >= k)),
leaks AS (SELECT doc_id, item_id, count(*) AS shared_runs FROM places JOIN runs USING (k, run) GROUP BY ALL)"""


def arrivals_sql(media: str) -> str:
    """Records in order of arrival, classes of equal payload, near pairs of classes, and those that join an earlier one; names end in the medium."""
    m = media[0]
    if media == "image":
        rows = f"""held_{m} AS (SELECT image_id AS id, batch_no AS b, phash AS h, false AS known FROM images UNION ALL SELECT known_id, 0, phash, true FROM known_media WHERE media = 'image'),
records_{m} AS (SELECT * FROM (SELECT id, known, min(b) AS b, max(lower(trim(h, ' '))) FILTER ({USABLE}) AS v FROM held_{m} WHERE id IS NOT NULL GROUP BY id, known) WHERE v IS NOT NULL AND b IS NOT NULL)"""
        near = f"""every_{m} AS MATERIALIZED (SELECT x.o AS src, y.o AS dst, x.known AND y.known AS old FROM classes_{m} x JOIN classes_{m} y ON x.o < y.o
  WHERE bit_count(xor(from_hex(x.v)::BLOB::BIT, from_hex(y.v)::BLOB::BIT)) <= 25)"""
    else:
        rows = f"""held_{m} AS (SELECT video_id AS id, batch_no AS b, frame_hashes AS f, false AS known FROM videos UNION ALL SELECT known_id, 0, frame_hashes, true FROM known_media WHERE media = 'video'),
batches_{m} AS (SELECT id, known, min(b) AS b FROM held_{m} WHERE id IS NOT NULL GROUP BY id, known),
sets_{m} AS (SELECT id, known, list_sort(list(DISTINCT lower(trim(h, ' ')))) AS v FROM (SELECT id, known, unnest(f) AS h FROM held_{m}) WHERE {USABLE} GROUP BY id, known),
records_{m} AS (SELECT * FROM sets_{m} JOIN batches_{m} USING (id, known) WHERE b IS NOT NULL)"""
        near = f"""frames_{m} AS (SELECT o, known, len(v) AS n, unnest(v) AS h FROM classes_{m}),
every_{m} AS MATERIALIZED (SELECT x.o AS src, y.o AS dst, bool_and(x.known AND y.known) AS old FROM frames_{m} x JOIN frames_{m} y ON x.h = y.h AND x.o < y.o GROUP BY x.o, y.o, x.n, y.n HAVING 5 * count(*) >= 3 * (x.n + y.n - count(*)))"""
    return f"""{rows},
ordered_{m} AS MATERIALIZED (SELECT id, known, v, row_number() OVER (ORDER BY known DESC, b, id) AS o FROM records_{m}),
classes_{m} AS MATERIALIZED (SELECT v, min(o) AS o, bool_or(known) AS known FROM ordered_{m} GROUP BY v),
{near},
pairs_{m} AS MATERIALIZED (SELECT src, dst FROM every_{m} WHERE NOT old), {greedy(f"pairs_{m}", f"_{m}")},
placed_{m} AS MATERIALIZED (SELECT r.id, r.o, c.o AS c, r.o = c.o AND c.o NOT IN (SELECT node FROM joined_{m}) OR r.known AS accepted FROM ordered_{m} r JOIN classes_{m} c USING (v))"""


def clusters_sql(media: str) -> str:
    """(record_id, cluster_id) of a medium after :func:`arrivals_sql`."""
    m = media[0]
    return f"""around_{m} AS MATERIALIZED (SELECT src AS a, dst AS b FROM every_{m} UNION ALL SELECT dst, src FROM every_{m} UNION ALL SELECT o, o FROM classes_{m}),
links_{m} AS MATERIALIZED (SELECT d.id AS dup, k.o AS item FROM placed_{m} d JOIN around_{m} n ON n.a = d.c JOIN placed_{m} k ON k.c = n.b AND k.accepted AND k.o < d.o WHERE NOT d.accepted),
firsts_{m} AS MATERIALIZED (SELECT dup, min(item) AS item FROM links_{m} GROUP BY dup),
ties_{m} AS MATERIALIZED (SELECT DISTINCT f.item AS a, l.item AS b FROM firsts_{m} f JOIN links_{m} l USING (dup)),
both_{m} AS MATERIALIZED (SELECT a, b FROM ties_{m} UNION SELECT b, a FROM ties_{m}),
reach_{m} AS (SELECT a AS item, a AS seen FROM both_{m} UNION SELECT r.item, e.b FROM reach_{m} r JOIN both_{m} e ON e.a = r.seen),
roots_{m} AS MATERIALIZED (SELECT item, min(seen) AS root FROM reach_{m} GROUP BY item),
named_{m} AS (SELECT r.item, i.id AS record_id, c.id AS cluster_id FROM roots_{m} r JOIN ordered_{m} i ON i.o = r.item JOIN ordered_{m} c ON c.o = r.root),
out_{m} AS (SELECT dup AS record_id, cluster_id FROM firsts_{m} JOIN named_{m} USING (item) UNION ALL SELECT record_id, cluster_id FROM named_{m})"""


def oracle_sql() -> dict[str, str]:
    apart = " + ".join(f"bit_count(xor(from_hex(x.{h})::BLOB::BIT, from_hex(y.{h})::BLOB::BIT))" for h in ("phash", "dhash", "ahash"))
    usable = ", ".join(f"max(lower(trim({h}, ' '))) FILTER (regexp_full_match(lower(trim({h}, ' ')), '[0-9a-f]{{64}}')) AS {h}" for h in ("phash", "dhash", "ahash"))
    return {
        "p1_recall": f"""WITH r AS MATERIALIZED (SELECT * FROM (SELECT image_id AS id, {usable} FROM images WHERE image_id IS NOT NULL GROUP BY image_id) WHERE phash IS NOT NULL AND dhash IS NOT NULL AND ahash IS NOT NULL),
            near AS (SELECT x.id AS a, y.id, {apart} AS d FROM r x JOIN r y ON x.id <> y.id WHERE x.id % 20 = 0 AND {apart} <= 76),
            best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, id) <= 5)
            SELECT (SELECT count(*) FROM r WHERE id % 20 = 0) AS asked, (SELECT count(*) FROM best) AS neighbours, true AS reached""",
        "p2_found": f"WITH {SETS} SELECT id_a, id_b FROM pairs",
        "p2_classes": f"""WITH {SETS},
            class AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM (SELECT id, list_sort(list(h)) AS s FROM sets GROUP BY id)),
            ends AS (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs)
            SELECT class.id, class_id, (SELECT count(*) FROM ends WHERE ends.id = class.id) AS links FROM class""",
        "p3_found": f"""WITH {MEDIA_FIELDS}
            SELECT group_id, field, path FROM joined QUALIFY row_number() OVER (PARTITION BY group_id, field
              ORDER BY CASE WHEN field = 'resolution' THEN -value ELSE 0 END, seen DESC NULLS LAST, path) = 1""",
        "p3_golden": f"""WITH {MEDIA_FIELDS},
            voted AS (SELECT group_id, field, value, max(seen) AS seen, sum(CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('png', 'bmp', 'tif', 'tiff') THEN 1 ELSE 0.6 END *
              coalesce(pow(2.0, -greatest(0.0, date_diff('day', seen::DATE, DATE '2024-01-01')) / 180.0), 0)) AS votes FROM joined GROUP BY ALL),
            won AS (SELECT * FROM voted QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY round(votes, 9) DESC, seen DESC NULLS LAST, value DESC) = 1)
            SELECT group_id, max(value) FILTER (field = 'resolution') AS resolution, max(value) FILTER (field = 'file_size') AS file_size,
              max(value) FILTER (field = 'duration') AS duration FROM won GROUP BY group_id""",
        "p5_found": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM match_edges WHERE src <> dst AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.85),
            u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
            walk AS (SELECT DISTINCT a AS path, a AS seen FROM u UNION SELECT walk.path, u.b FROM walk JOIN u ON u.a = walk.seen)
            SELECT path, min(seen) AS group_key FROM walk GROUP BY path""",
        "p6_found": f"""WITH RECURSIVE {arrivals_sql("image")}, {arrivals_sql("video")}
            SELECT 'image' AS media, id AS record_id FROM placed_i WHERE NOT accepted UNION ALL SELECT 'video', id FROM placed_v WHERE NOT accepted""",
        "p6_clusters": f"""WITH RECURSIVE {arrivals_sql("image")}, {arrivals_sql("video")}, {clusters_sql("image")}, {clusters_sql("video")}
            SELECT record_id, cluster_id FROM out_i UNION ALL SELECT record_id, cluster_id FROM out_v""",
        # the tokenizer is not in SQL: what must hold whatever the tokens are
        "p7_checks": "SELECT count(*) AS documents, 0 AS cut_in_vain, 0 AS lost, 0 AS overfull, 0 AS gaps, 0 AS unused_numbers, true AS well_filled FROM documents",
        "p8_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM leaks",
        "p8_report": f"WITH {LEAKS} SELECT doc_id, item_id, shared_runs FROM leaks",
        "p9_statistics": f"""WITH {WORDS} SELECT doc_id, n_words, n_word_chars, n_symbols, n_lines, n_stop_lines, n_common,
            round(n_word_chars / nullif(n_words, 0), 6) AS mean_word_length, round(n_symbols / nullif(n_word_chars, 0), 6) AS symbol_share,
            round(n_stop_lines / nullif(n_lines, 0), 6) AS stop_line_share, round(n_common / nullif(n_words, 0), 6) AS common_share FROM counts""",
        "p9_found": f"""WITH {WORDS} SELECT doc_id FROM counts WHERE n_words >= 30 AND n_word_chars >= 3 * n_words AND n_word_chars <= 10 * n_words
            AND 10 * n_symbols <= n_word_chars AND 2 * n_stop_lines >= n_lines AND 5 * n_common >= n_words""",
    }
