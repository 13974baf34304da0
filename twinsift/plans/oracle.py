"""The queries of this package in DuckDB's SQL."""

from __future__ import annotations

from twinsift.constants import EXCLUDED_FOLDERS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

HASH_ROWS = """
rows AS (
  SELECT 'image' AS media, lower(trim(phash, ' ')) AS hash_key, image_id AS id, file_size FROM images WHERE regexp_full_match(lower(trim(phash, ' ')), '[0-9a-f]{64}')
  UNION ALL
  SELECT 'video', lower(trim(average_hash, ' ')), video_id, file_size FROM videos WHERE regexp_full_match(lower(trim(average_hash, ' ')), '[0-9a-f]{32}'))
"""

ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("ingested_at", "scanned_at", "file_size", "width", "height"))
IMAGE = f"image_rows AS (SELECT * FROM images WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY {ORDER}) = 1)"
VIDEO = f"video_rows AS (SELECT * FROM videos WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY {ORDER}, duration DESC NULLS LAST) = 1)"


def usable(c: str) -> str:
    return f"CASE WHEN regexp_full_match(lower(trim({c}, ' ')), '[0-9a-f]{{64}}') THEN lower(trim({c}, ' ')) END AS {c}"


VALID = f"{IMAGE}, valid AS (SELECT * FROM (SELECT path, image_id, file_size, {', '.join(usable(k) for k in ('phash', 'ahash', 'dhash', 'whash'))} FROM image_rows) WHERE phash IS NOT NULL)"
PATHS = "paths AS (SELECT path FROM images UNION ALL SELECT path FROM videos)"
INFOS = f"{IMAGE}, {VIDEO}, infos AS (SELECT path, file_size FROM image_rows UNION ALL SELECT path, file_size FROM video_rows)"
GROUPS = "groups AS (SELECT group_id, media, leader, path, max(similarity) AS similarity, min(rank) AS rank FROM dup_groups GROUP BY ALL)"


def endings(extensions: list[str]) -> str:
    return "(" + "|".join(e[1:] for x in sorted(extensions) for e in dict.fromkeys((x, x.upper()))) + ")"


def excluded(column: str) -> str:
    return " OR ".join(f"contains(lower({column}), '{t}')" for t in sorted(EXCLUDED_FOLDERS))


def differ(a: str, b: str) -> str:
    return f"bit_count(xor(from_hex({a})::BLOB::BIT, from_hex({b})::BLOB::BIT))"


def by_kind(k: str) -> str:
    first = "coalesce(nullif(phash, ''), nullif(ahash, ''), nullif(dhash, ''), '')"
    return f"coalesce(nullif({k}, ''), {first}) AS by_{k}" if k != "combined" else f"{first} AS by_combined"


GRID = "grid AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings WHERE len(embedding) = 64)"


def hex_of(bits: str, digits: int) -> str:
    """A list of booleans or 0/1 as hex text."""
    return (
        f"array_to_string(list_transform(range({digits}), lambda i: format('{{:x}}', ({bits})[4*i+1]::INT * 8 + ({bits})[4*i+2]::INT * 4 + ({bits})[4*i+3]::INT * 2 + ({bits})[4*i+4]::INT)), '')"
    )


def hex_text(bits: str, digits: int) -> str:
    return f"SELECT vec_id, {hex_of('b', digits)} AS h FROM (SELECT vec_id, {bits} AS b FROM grid)"


CODES = f"{GRID}, codes AS (SELECT vec_id, {hex_of('b', 16)} AS h FROM (SELECT vec_id, list_transform(p, lambda x: x > (list_sort(p)[32] + list_sort(p)[33]) / 2) AS b FROM grid))"

KINDS = ("phash", "ahash", "dhash", "whash")
SIMS = ", ".join(f"CASE WHEN x.{k} IS NOT NULL AND y.{k} IS NOT NULL THEN 1 - {differ(f'x.{k}', f'y.{k}')} / 256.0::DOUBLE END" for k in KINDS)
CLASSES = f"{VALID}, classes AS (SELECT {', '.join(KINDS)}, min(path) AS path FROM valid GROUP BY {', '.join(KINDS)})"
# the mean of sixteenths of 256ths is exact, so order of summing does not matter for four kinds; others are rounded by neither side
PAIRS = f"""pairs AS MATERIALIZED (SELECT * FROM (SELECT x.path AS src, y.path AS dst, list_sum(list_filter([{SIMS}], lambda s: s IS NOT NULL)) / len(list_filter([{SIMS}], lambda s: s IS NOT NULL)) AS similarity
  FROM classes x JOIN classes y ON x.path < y.path) WHERE similarity >= 0.9)"""


def greedy(pairs: str, mark: str = "") -> str:
    """(node, leader) by first come: nodes in order, one per step of the recursion.  ``mark`` ends the names of the tables, the last of them joined."""
    return f"""
nodes{mark} AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS n FROM (SELECT src AS node FROM {pairs} UNION SELECT dst FROM {pairs})),
back{mark} AS MATERIALIZED (SELECT d.n AS n, list_sort(list(s.n)) AS earlier FROM {pairs} p JOIN nodes{mark} s ON s.node = p.src JOIN nodes{mark} d ON d.node = p.dst GROUP BY d.n),
steps{mark} AS MATERIALIZED (SELECT nodes{mark}.n, coalesce(earlier, []) AS earlier FROM nodes{mark} LEFT JOIN back{mark} USING (n)),
walk{mark} AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders, NULL::BIGINT AS joined
  UNION ALL SELECT s.n, CASE WHEN len(list_intersect(s.earlier, w.leaders)) = 0 THEN list_append(w.leaders, s.n) ELSE w.leaders END, list_min(list_intersect(s.earlier, w.leaders))
  FROM walk{mark} w JOIN steps{mark} s ON s.n = w.n + 1),
joined{mark} AS MATERIALIZED (SELECT a.node AS node, b.node AS leader FROM walk{mark} w JOIN nodes{mark} a ON a.n = w.n JOIN nodes{mark} b ON b.n = w.joined)"""


def near_groups(rows: str, classes: str, pairs: str, kinds: tuple[str, ...]) -> str:
    """Groups over rows, copies of a class following it."""
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM c.{k}" for k in kinds)
    return f"""{greedy(pairs)},
placed AS (SELECT leader, node AS class, similarity FROM joined JOIN {pairs} p ON p.src = leader AND p.dst = node
  UNION ALL SELECT DISTINCT leader, leader, 1.0 FROM joined),
held AS (SELECT r.path, c.path AS class, count(*) OVER (PARTITION BY c.path) AS copies FROM {rows} r JOIN {classes} c ON {on}),
near AS (SELECT leader, path, similarity FROM held JOIN placed USING (class)
  UNION ALL SELECT class, path, 1.0 FROM held WHERE copies > 1 AND class NOT IN (SELECT class FROM placed))"""


EXACT = """exact AS (SELECT min(path) OVER (PARTITION BY phash) AS leader, path, 1.0::DOUBLE AS similarity FROM valid QUALIFY count(*) OVER (PARTITION BY phash) > 1)"""
REST = "rest AS (SELECT * FROM valid QUALIFY count(*) OVER (PARTITION BY phash) = 1)"

FRAMES = f"""{VIDEO}, clean AS (SELECT video_id, path, list_filter(list_transform(frame_hashes, lambda h: lower(trim(h, ' '))), lambda h: length(h) = 64 AND regexp_full_match(h, '[0-9a-f]+')) AS f FROM video_rows),
sequences AS MATERIALIZED (SELECT min(video_id) AS path, f FROM clean WHERE len(f) > 0 GROUP BY f)"""


def video_pairs(divisor: str, threshold: float, prefilter: bool, queries: str = "x.path % 20 = 0", table: str = "sequences", order: str = "<") -> str:
    best = f"list_max(list_transform(y.f, lambda b: greatest(0.0, 1 - {differ('a', 'b')} / {divisor}::DOUBLE)))"
    mean = f"list_sum(list_transform(x.f, lambda a: {best})) / len(x.f)"
    first = f" AND 1 - {differ('x.f[1]', 'y.f[1]')} / 256.0 >= {max(0.5, threshold - 0.2)}" if prefilter else ""
    return f"SELECT x.path AS src, y.path AS dst, {mean} AS similarity FROM {table} x JOIN {table} y ON x.path {order} y.path WHERE {queries}{first} AND {mean} >= {threshold}"


SIZE = "CASE " + " ".join(f"WHEN file_size / {1024**p}::DOUBLE < 1024 THEN printf('%.2f {u}', file_size / {1024**p}::DOUBLE)" for p, u in enumerate(("B", "KB", "MB", "GB"))) + f" ELSE printf('%.2f TB', file_size / {1024**4}::DOUBLE) END"


def duration(c: str) -> str:
    whole = f"floor({c})::BIGINT"
    s = f"CASE WHEN {whole} >= 0 THEN {whole} ELSE ({whole} % 3600 + 3600) % 3600 END"
    s = f"({s})"
    return f"CASE WHEN {s} >= 3600 THEN printf('%dh %dm %ds', {s} // 3600, {s} % 3600 // 60, {s} % 60) WHEN {s} >= 60 THEN printf('%dm %ds', {s} // 60, {s} % 60) ELSE printf('%ds', {s}) END"


DURATION = f"CASE WHEN duration IS NOT NULL AND isfinite(duration) THEN {duration('CASE WHEN isfinite(duration) THEN duration END')} END"
PERCENT = "CASE WHEN similarity IS NOT NULL THEN printf('%.1f%%', similarity * 100) END"
MEMBER = f"group_id, rank, path, width::VARCHAR || 'x' || height::VARCHAR AS resolution, CASE WHEN file_size IS NOT NULL THEN {SIZE} END AS size, {PERCENT} AS similarity_text"
SAVED = "saved AS (SELECT group_id, count(*) AS members, count(file_size) AS known, CASE WHEN count(file_size) > 1 THEN sum(file_size) - max(file_size) ELSE 0 END::BIGINT AS savings FROM groups LEFT JOIN infos USING (path) GROUP BY group_id)"
LEVELS = "list_transform(p, lambda x: greatest(0, least(255, floor((x + 1) * 127.5))))"
MOSAICS = f"""tiles AS (SELECT vec_id // 16 AS mosaic, vec_id % 16 AS tile, {LEVELS} AS p FROM grid),
        px AS (SELECT mosaic, (tile * 64 + i) // 32 AS r, (tile * 64 + i) % 32 AS c, p[i + 1] AS v FROM tiles, range(64) t(i) WHERE mosaic IN (SELECT mosaic FROM tiles GROUP BY 1 HAVING count(*) = 16))"""

SQL = {
    "p4_found": f"""WITH {HASH_ROWS},
        records AS (SELECT media, hash_key, id, max(greatest(coalesce(file_size, 0), 0)) AS size FROM rows WHERE id IS NOT NULL GROUP BY ALL)
        SELECT media, hash_key, id AS top_id FROM records
        QUALIFY count(*) OVER (PARTITION BY media, hash_key) >= 2 AND row_number() OVER (PARTITION BY media, hash_key ORDER BY size DESC, id) = 1""",
    "p4_summary": f"""WITH {HASH_ROWS},
        w AS (SELECT media, hash_key, file_size AS v, count(*) AS n FROM rows GROUP BY ALL),
        m AS (SELECT media, hash_key, v AS mode, n AS mode_weight FROM w WHERE v IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY media, hash_key ORDER BY n DESC, v) = 1)
        SELECT r.media, r.hash_key, count(*) AS records, count(DISTINCT file_size) AS n_values, any_value(mode) AS mode, any_value(mode_weight) AS mode_weight,
          quantile_disc(file_size, 0.5) AS p50, quantile_disc(file_size, 0.9) AS p90
        FROM rows r LEFT JOIN m USING (media, hash_key) GROUP BY r.media, r.hash_key""",
    "scan_extension_filter": f"""WITH {PATHS} SELECT DISTINCT path, CASE WHEN regexp_matches(path, '\\.{endings(IMAGE_EXTENSIONS)}$') THEN 'image' ELSE 'video' END AS media
        FROM paths WHERE regexp_matches(path, '\\.{endings(IMAGE_EXTENSIONS)}$') OR regexp_matches(path, '\\.{endings(VIDEO_EXTENSIONS)}$')""",
    "scan_exclusion_filter": f"WITH {PATHS} SELECT DISTINCT path FROM paths WHERE path IS NOT NULL AND NOT ({excluded('path')})",
    "scan_distinct_sorted": f"WITH {PATHS} SELECT DISTINCT path FROM paths WHERE path IS NOT NULL ORDER BY path",
    "fingerprint_filter": f"WITH {IMAGE}, {VIDEO} SELECT path FROM image_rows WHERE phash <> '' UNION ALL SELECT path FROM video_rows WHERE len(frame_hashes) > 0",
    "hash_select_fallback": f"WITH {IMAGE} SELECT path, {', '.join(by_kind(k) for k in (*KINDS, 'combined'))} FROM image_rows",
    "hex_roundtrip": f"WITH {VALID} SELECT path, phash AS back, {', '.join(f"(CASE WHEN phash[{16 * i + 1}] >= '8' THEN ('0x' || phash[{16 * i + 1}:{16 * i + 16}])::HUGEINT - 18446744073709551616::HUGEINT ELSE ('0x' || phash[{16 * i + 1}:{16 * i + 16}])::HUGEINT END)::BIGINT AS w{i}" for i in range(4))} FROM valid",
    "median_hash_bits": f"WITH {CODES} SELECT vec_id, h FROM codes",
    "ahash_bits": f"WITH {GRID} {hex_text('list_transform(p, lambda x: x > round(list_sum(p) / 64, 9))', 16)}",
    "dhash_bits": f"WITH {GRID} {hex_text('list_transform(list_filter(range(64), lambda i: i % 8 <> 0), lambda i: p[i + 1] > p[i])', 14)}",
    "whash_haar_bits": f"""WITH {GRID}, low AS (SELECT vec_id, list_transform(range(16), lambda i: round((p[(i // 4) * 16 + (i % 4) * 2 + 1] + p[(i // 4) * 16 + (i % 4) * 2 + 2]
          + p[(i // 4) * 16 + (i % 4) * 2 + 9] + p[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4, 9)) AS p FROM grid)
        SELECT vec_id, {hex_of('b', 4)} AS h FROM (SELECT vec_id, list_transform(p, lambda x: x > (list_sort(p)[8] + list_sort(p)[9]) / 2) AS b FROM low)""",
    # bilinear: a target pixel lies at (i + 1/2) * source / target - 1/2 between two source pixels
    "mosaic_pixel_hashes": f"""WITH {GRID}, {MOSAICS},
        places AS (SELECT n, i, floor((i + 0.5) * 32 / n - 0.5)::INT AS low, (i + 0.5) * 32 / n - 0.5 - floor((i + 0.5) * 32 / n - 0.5) AS share FROM (SELECT 8 AS n, unnest(range(8)) AS i UNION ALL SELECT 9, unnest(range(9)))),
        ends AS (SELECT n, i, greatest(0, least(31, low)) AS at, 1 - share AS w FROM places UNION ALL SELECT n, i, greatest(0, least(31, low + 1)), share FROM places),
        tall AS (SELECT mosaic, e.i AS r, c, sum(w * v) AS v FROM px JOIN ends e ON e.n = 8 AND e.at = r GROUP BY ALL),
        small AS (SELECT mosaic, e.n AS n, r, e.i AS c, round_even(sum(w * v), 0) AS v FROM tall JOIN ends e ON e.at = c GROUP BY ALL),
        a AS (SELECT mosaic, list(v > m ORDER BY r, c) AS b FROM (SELECT *, avg(v) OVER (PARTITION BY mosaic) AS m FROM small WHERE n = 8) GROUP BY mosaic),
        d AS (SELECT mosaic, list(v > before ORDER BY r, c) FILTER (c > 0) AS b FROM (SELECT *, lag(v) OVER (PARTITION BY mosaic, r ORDER BY c) AS before FROM small WHERE n = 9) GROUP BY mosaic),
        low AS (SELECT mosaic, r // 4 AS r, c // 4 AS c, avg(v) AS v FROM px GROUP BY ALL),
        w AS (SELECT mosaic, list(v > m ORDER BY r, c) AS b FROM (SELECT *, median(v) OVER (PARTITION BY mosaic) AS m FROM low) GROUP BY mosaic)
        SELECT mosaic, {hex_of('a.b', 16)} AS ahash, {hex_of('d.b', 16)} AS dhash, {hex_of('w.b', 16)} AS whash FROM a JOIN d USING (mosaic) JOIN w USING (mosaic)""",
    "mosaic_phash_bits": f"""WITH {GRID}, {MOSAICS},
        basis AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1 / 32.0) ELSE sqrt(2 / 32.0) * cos(pi() * (2 * i + 1) * k / 64.0) END AS w FROM range(8) a(k), range(32) b(i)),
        half AS (SELECT mosaic, k AS kr, c, sum(w * v) AS v FROM px JOIN basis ON i = r GROUP BY ALL),
        low AS (SELECT mosaic, kr, k AS kc, sum(w * v) AS v FROM half JOIN basis ON i = c GROUP BY ALL),
        bits AS (SELECT mosaic, list(v > m ORDER BY kr, kc) AS b FROM (SELECT *, median(v) OVER (PARTITION BY mosaic) AS m FROM low) GROUP BY mosaic)
        SELECT mosaic, {hex_of('b', 16)} AS h FROM bits""",
    "exact_hash_groups": f"WITH {VALID}, {EXACT} SELECT leader, path, similarity FROM exact",
    "remaining_after_exact": f"WITH {VALID}, {REST} SELECT path FROM rest",
    "near_pairs_phash": f"""WITH {VALID}, c AS (SELECT phash, min(path) AS path FROM valid GROUP BY phash)
        SELECT x.path AS a, y.path AS b, 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE AS similarity FROM c x JOIN c y ON x.path < y.path WHERE 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE >= 0.9""",
    "near_pairs_combined": f"WITH {CLASSES}, {PAIRS} SELECT src, dst, similarity FROM pairs",
    "near_groups_greedy": f"WITH RECURSIVE {CLASSES}, {PAIRS}, {near_groups('valid', 'classes', 'pairs', KINDS)} SELECT leader, path, similarity FROM near",
    "fast_groups_union": f"""WITH RECURSIVE {VALID}, {EXACT}, {REST},
        pairs AS MATERIALIZED (SELECT x.path AS src, y.path AS dst, 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE AS similarity FROM rest x JOIN rest y ON x.path < y.path
          WHERE 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE >= 0.9), {near_groups('rest', 'rest', 'pairs', ('path',))}
        SELECT 0 AS phase, leader, path, similarity FROM exact UNION ALL SELECT 1, leader, path, similarity FROM near""",
    "numbered_near_members": f"""WITH RECURSIVE {VALID}, {EXACT}, {REST},
        pairs AS MATERIALIZED (SELECT x.path AS src, y.path AS dst, 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE AS similarity FROM rest x JOIN rest y ON x.path < y.path
          WHERE 1 - {differ('x.phash', 'y.phash')} / 256.0::DOUBLE >= 0.9), {near_groups('rest', 'rest', 'pairs', ('path',))},
        both_phases AS (SELECT 0 AS phase, leader, path, similarity FROM exact UNION ALL SELECT 1, leader, path, similarity FROM near)
        SELECT dense_rank() OVER (ORDER BY phase, leader)::INT AS group_id, leader, path, similarity,
          row_number() OVER (PARTITION BY phase, leader ORDER BY coalesce(file_size, 0) DESC, path)::INT AS rank FROM both_phases JOIN (SELECT path, file_size FROM valid) USING (path)""",
    "group_ranked_members": f"""WITH {VALID}, {EXACT} SELECT dense_rank() OVER (ORDER BY leader)::INT AS group_id, leader, path, similarity,
        row_number() OVER (PARTITION BY leader ORDER BY coalesce(file_size, 0) DESC, path)::INT AS rank FROM exact JOIN (SELECT path, file_size FROM valid) USING (path)""",
    "similarity_matrix": f"WITH {CODES} SELECT x.vec_id AS a, y.vec_id AS b, 1 - {differ('x.h', 'y.h')} / 64.0::DOUBLE AS similarity FROM codes x, codes y WHERE x.vec_id % 20 = 0",
    "hamming_rectangular": f"""WITH {VALID}, known AS (SELECT known_id, lower(trim(phash, ' ')) AS h FROM known_media WHERE media = 'image' AND known_id % 20 = 0 AND regexp_full_match(lower(trim(phash, ' ')), '[0-9a-f]{{64}}')),
        c AS (SELECT phash, min(path) AS path FROM valid GROUP BY phash)
        SELECT known_id AS a, path AS b, {differ('h', 'phash')}::INT AS distance FROM known, c""",
    "frame_sampling": f"""WITH {VIDEO}, n AS (SELECT video_id, frame_count AS n, trunc(frame_count * 0.05::DOUBLE)::BIGINT AS a, trunc(frame_count * 0.95::DOUBLE)::BIGINT AS z FROM video_rows),
        m AS (SELECT video_id, n, CASE WHEN z <= a THEN 0 ELSE a END AS a, CASE WHEN z <= a THEN n - 1 ELSE z END AS z FROM n)
        SELECT video_id, n AS frame_count, CASE WHEN n > 0 THEN array_to_string(list_filter(list_transform(range(1, 11), lambda i: a + i * greatest(1, floor((z - a) / 11.0)::BIGINT)), lambda p: p < n), ',') ELSE '' END AS frames FROM m""",
    "video_metadata": f"""WITH {VIDEO} SELECT video_id, coalesce(nullif(fps, 0), 30.0) AS fps,
        CASE WHEN frame_count > 0 AND coalesce(nullif(fps, 0), 30.0) > 0 THEN round(frame_count / coalesce(nullif(fps, 0), 30.0), 6) ELSE 0.0 END AS duration FROM video_rows""",
    "video_average_hash": f"""WITH {VIDEO}, k AS (SELECT video_id, list_filter(frame_hashes, lambda h: h IS NOT NULL AND h <> '') AS f FROM video_rows)
        SELECT video_id, CASE WHEN len(f) > 0 THEN md5(array_to_string(f, '')) END AS average_hash FROM k""",
    "video_similarity_strict": f"WITH {FRAMES} SELECT src, dst, round(similarity, 6) AS similarity FROM ({video_pairs('256', 0.85, False)})",
    "video_similarity_compat": f"WITH {FRAMES} SELECT src, dst, round(similarity, 6) AS similarity FROM ({video_pairs('65536', 0.9965, False)})",
    "video_prefilter_refine": f"WITH {FRAMES} SELECT src, dst, round(similarity, 6) AS similarity FROM ({video_pairs('65536', 0.9965, True)})",
    **{
        name: f"WITH {FRAMES}, asked AS MATERIALIZED (SELECT min(video_id) AS path, bool_or(video_id % 20 = 0) AS asked, f FROM clean WHERE len(f) > 0 GROUP BY f) SELECT src, dst, round(similarity, 6) AS similarity FROM ({video_pairs(*how, 'x.asked', 'asked', '<>')})"
        for name, how in {"video_queries_strict": ("256", 0.85, False), "video_queries_compat": ("65536", 0.9965, False), "video_queries_prefilter": ("65536", 0.9965, True)}.items()
    },
    "video_class_members": f"WITH {FRAMES} SELECT video_id, sequences.path AS class_id FROM clean JOIN sequences USING (f)",
    "image_class_members": f"WITH {VALID} SELECT path, min(path) OVER (PARTITION BY {', '.join(KINDS)}) AS class_path FROM valid",
    "video_groups_strict": f"""WITH RECURSIVE {FRAMES}, held_rows AS MATERIALIZED (SELECT path, f FROM clean WHERE len(f) > 0), by_path AS MATERIALIZED (SELECT min(path) AS path, f FROM held_rows GROUP BY f),
        pairs AS MATERIALIZED ({video_pairs('256', 0.85, False, 'true', 'by_path')}), {near_groups('held_rows', 'by_path', 'pairs', ('f',))} SELECT leader, path, round(similarity, 6) AS similarity FROM near""",
    "group_report": f"""WITH {IMAGE}, {GROUPS} SELECT {MEMBER}, CASE WHEN format IS NULL OR format = '' THEN 'Unknown' ELSE format END AS format
        FROM groups JOIN image_rows USING (path) WHERE media = 'image'""",
    "group_report_videos": f"WITH {VIDEO}, {GROUPS} SELECT {MEMBER}, {DURATION} AS duration FROM groups JOIN video_rows USING (path) WHERE media = 'video'",
    "group_savings": f"WITH {INFOS}, {GROUPS}, {SAVED} SELECT * FROM saved",
    "duplicate_totals": f"WITH {INFOS}, {GROUPS}, {SAVED} SELECT count(*) AS total_groups, coalesce(sum(members - 1), 0)::BIGINT AS total_duplicates, coalesce(sum(savings), 0)::BIGINT AS potential_savings_bytes FROM saved",
    "format_size": f"WITH {INFOS} SELECT DISTINCT file_size, {SIZE} AS size FROM infos WHERE file_size IS NOT NULL",
    "format_duration": f"WITH {VIDEO} SELECT video_id, {DURATION} AS text FROM video_rows",
    "resolution_label": f"WITH {IMAGE} SELECT image_id, width::VARCHAR || 'x' || height::VARCHAR AS resolution FROM image_rows",
    "similarity_percent": f"SELECT DISTINCT similarity, {PERCENT} AS text FROM match_edges WHERE similarity IS NOT NULL AND NOT isnan(similarity)",
}
