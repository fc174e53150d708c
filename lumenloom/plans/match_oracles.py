"""DuckDB oracles of match_queries."""

from __future__ import annotations

from lumenloom.plans import fixtures as fx
from lumenloom.plans.name_queries import _EXT, _LADDER, _MEASURED, _STEM
from lumenloom.plans.sequence_queries import NEAR

_F = "WITH " + fx.FILES
_A = "WITH " + fx.ARCHIVE
_GROUPS = _F + ", g AS (SELECT md5, count(*) AS n, min(path) AS representative, sum(size) - min_by(size, path) AS wasted FROM files GROUP BY md5 HAVING count(*) > 1)"
_RANKED = _F + ", k AS (SELECT *, count(*) OVER (PARTITION BY md5) AS copies, row_number() OVER (PARTITION BY md5 ORDER BY mtime DESC, path) AS rank FROM files QUALIFY copies > 1)"
_PAIRS = "WITH " + fx.HASHES + ", pairs AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash)::BIT)::INTEGER AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)::BIT) <= 5)"

_ARBITRATE = """CASE WHEN {sp} > {ep} * 1.1 THEN 'n resolution' WHEN {ep} > {sp} * 1.1 THEN 'y resolution'
  WHEN {sh} AND NOT {eh} THEN 'n codec' WHEN {eh} AND NOT {sh} THEN 'y codec' WHEN {es}::DOUBLE / {ss} > 2.0 THEN 'n bloat' WHEN {es}::DOUBLE / {ss} < 0.5 THEN 'y bloat'
  WHEN {es}::DOUBLE / {ss} > 1.20::DOUBLE THEN 'n size' WHEN {es}::DOUBLE / {ss} < 0.83::DOUBLE THEN 'y size' ELSE 'y similar' END"""
_DECIDED = _A + """, pairs AS (SELECT a.path, a.size, a.pixels, a.codec, o.path AS e_path, o.size AS e_size, o.pixels AS e_pixels, o.codec AS e_codec, o.path IS NOT NULL AND abs(a.duration - o.duration) <= 1 AS match,
    abs(a.size - o.size)::DOUBLE / greatest(a.size, o.size) AS apart FROM archive a LEFT JOIN organized o USING (base)
), one AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(match, false) DESC, e_path) = 1
), c AS (SELECT *, CASE WHEN e_path IS NULL THEN 'NONE' WHEN NOT match THEN 'LOW' WHEN apart <= 0.01 THEN 'EXACT' WHEN apart <= 0.20 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, """ + _ARBITRATE.format(sp="pixels", ep="e_pixels", sh="codec = 'hevc'", eh="e_codec = 'hevc'", es="e_size", ss="size") + """ AS arb FROM one
), decisions AS (SELECT path, confidence, e_path AS existing_path, coalesce(match, false) AS is_duplicate, CASE WHEN confidence = 'MEDIUM' THEN arb LIKE 'y%' ELSE coalesce(match, false) END AS prefer_existing, CASE WHEN confidence = 'MEDIUM' THEN substr(arb, 3) END AS rung,
    CASE WHEN confidence IN ('EXACT', 'HIGH') THEN 'skipped' WHEN confidence = 'MEDIUM' THEN CASE WHEN arb LIKE 'y%' THEN 'skipped' ELSE 'replaced' END ELSE 'moved' END AS action FROM c)"""  # fmt: skip

_LISTING = fx.CAPTURES + f""", base AS (SELECT event_id, dir, name, blur, size FROM captures), listing AS (SELECT *, dir || '/' || name AS path FROM (SELECT * FROM base UNION ALL SELECT event_id + 1000000, dir, {_STEM} || '-edited.jpg', blur * 1.2, size FROM base WHERE event_id % 16 = 0)),
own AS (SELECT dir, name, {_STEM} AS stem, {_EXT} AS ext FROM listing),
edited AS (SELECT DISTINCT dir, name AS edited, ext AS edited_ext, regexp_replace(stem, '( \\(edited\\)|[-_ ]edited|[-_]edit)$', '', 'i') AS stem FROM own WHERE regexp_matches(stem, '(?i)( \\(edited\\)|[-_ ]edited|[-_]edit)$')),
pairs AS (SELECT e.dir, e.edited, o.name AS original FROM edited e JOIN own o ON e.dir = o.dir AND e.stem = o.stem QUALIFY row_number() OVER (PARTITION BY e.dir, e.edited ORDER BY o.ext <> e.edited_ext, o.ext, o.name) = 1),
members AS (SELECT dir, edited AS name FROM pairs UNION SELECT dir, original FROM pairs)"""  # fmt: skip

_PRIORITY = "CASE WHEN path LIKE '%\\_TO\\_REVIEW\\_%' ESCAPE '\\' THEN 0 WHEN path LIKE '%/01 January/%' THEN 1 ELSE 2 END"
_ORPHANS = "WITH " + fx.SIDECARS + f""", here AS (SELECT dir, name, min(path) AS media_path FROM media GROUP BY dir, name), there AS (SELECT name, min({_PRIORITY} || path) AS best FROM media GROUP BY name),
orphans AS (SELECT s.event_id, media_path, CASE WHEN media_path IS NULL THEN substr(best, 2) END AS recover_path, CASE WHEN media_path IS NULL THEN best[1]::INTEGER END AS priority, CASE WHEN media_path IS NOT NULL THEN 'local' WHEN best IS NOT NULL THEN 'recoverable' ELSE 'orphan' END AS status
  FROM sidecars s LEFT JOIN here h ON s.dir = h.dir AND s.original = h.name LEFT JOIN there t ON s.original = t.name)"""  # fmt: skip

_INDEX = fx.CAPTURES + f""", st AS (SELECT *, regexp_replace({_STEM}, '^(.+)_[A-Z][a-z]+$', '\\1') AS bare FROM captures), idx AS (SELECT event_id, name, regexp_replace(bare, '-edited$', '') AS base, {_EXT} AS ext, bare LIKE '%-edited' AS is_edited, dir || '/' || name AS path FROM st)"""

ORACLES = {
    "exact_duplicates": _GROUPS + " SELECT md5, n, representative, wasted::BIGINT AS wasted_bytes FROM g",
    "duplicate_waste": _GROUPS + " SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(wasted), 0)::BIGINT AS wasted_bytes FROM g",
    "keep_newest": _RANKED + " SELECT path, md5, copies, rank, CASE WHEN rank = 1 THEN 'keep' ELSE 'move' END AS action FROM k",
    "phash_bits": "WITH " + fx.HASHES + " SELECT id, printf('%016x', hash) AS hash FROM hashes",
    "phash_pairs": _PAIRS + " SELECT a, b, distance FROM pairs",
    "phash_components": _PAIRS + ", sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM hashes UNION"
        " SELECT b, root FROM r JOIN sym ON r.id = sym.a) SELECT id, min(root) AS component FROM r GROUP BY id) SELECT id, component FROM reach",
    "leftover_check": _A + ", s AS (SELECT base || '.mp4' AS name, size FROM archive) SELECT CASE WHEN NOT EXISTS (FROM organized o"
        " WHERE o.name = s.name) THEN 'not_found' WHEN EXISTS (FROM organized o WHERE o.name = s.name AND o.size = s.size) THEN 'duplicate'"
        " ELSE 'same_name_different_size' END AS status, count(*) AS n, sum(size)::BIGINT AS bytes FROM s GROUP BY status",
    "archive_missing": _A + " SELECT name, base AS date_pattern, size FROM archive WHERE base NOT IN (SELECT base FROM organized)",
    "duplicate_decisions": _DECIDED + " SELECT * FROM decisions",
    "run_counters": _DECIDED + " SELECT action, confidence, count(*) AS n FROM decisions GROUP BY ALL",
    "quality_arbitration": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 921600 ELSE 2073600 END AS sp, CASE WHEN p_partkey % 5 = 0 THEN 921600"
        " ELSE 2073600 END AS ep, p_partkey % 2 = 0 AS sh, p_partkey % 7 < 4 AS eh, 100 + p_partkey % 11 * 10 AS ss, 40 + p_partkey % 23 * 10 AS es"
        " FROM part), a AS (SELECT p_partkey, " + _ARBITRATE.format(sp="sp", ep="ep", sh="sh", eh="eh", es="es", ss="ss") + " AS r FROM p) SELECT p_partkey, r LIKE 'y%' AS prefer_existing, substr(r, 3) AS rung FROM a",
    "size_band_matches": _A + """, e AS (SELECT path, base AS prefix, size, size % 5 = 0 AS converted FROM organized)
      SELECT event_id, min(e.path) AS existing_path, coalesce(bool_or(converted), false) AS already_converted FROM archive a LEFT JOIN e ON a.base = e.prefix AND (converted OR e.size BETWEEN a.size * 0.95::DOUBLE AND a.size * 1.05::DOUBLE) GROUP BY event_id""",
    "edited_pairs": "WITH " + _LISTING + ", m AS (SELECT dir, name, max(blur) AS blur FROM listing GROUP BY dir, name) SELECT p.dir, edited, original, CASE"
        " WHEN e.blur > o.blur * 1.1 THEN 'edited sharper' WHEN o.blur > e.blur * 1.1 THEN 'original sharper' ELSE 'similar' END AS comparison"
        " FROM pairs p JOIN m e ON p.dir = e.dir AND p.edited = e.name JOIN m o ON p.dir = o.dir AND p.original = o.name",
    "protected_pairs": "WITH " + _LISTING + " SELECT (dir, name) IN (SELECT (dir, name) FROM members) AS protected, count(*) AS n FROM listing GROUP BY protected",
    "orphan_sidecars": _ORPHANS + " SELECT event_id, media_path, recover_path, status FROM orphans",
    "recover_priority": _ORPHANS + " SELECT priority, count(*) AS n, min(recover_path) AS first_path FROM orphans WHERE status = 'recoverable' GROUP BY priority",
    "fragmented_sidecars": "WITH " + fx.SIDECARS + """, named AS (SELECT dir, path, name AS media_name, 0 AS kind FROM media UNION ALL SELECT dir, path, regexp_replace(name, '-edited(\\.[^.]+)$', '\\1'), 1 FROM media WHERE regexp_matches(name, '-edited\\.[^.]+$')),
      orphans AS (SELECT event_id, original FROM sidecars s WHERE NOT EXISTS (FROM named n WHERE n.dir = s.dir AND n.media_name = s.original))
      SELECT event_id, substr(min(kind || path), 2) AS path, min(kind) = 1 AS edited_variant FROM orphans o JOIN named n ON o.original = n.media_name WHERE path NOT LIKE '%\\_TO\\_REVIEW\\_%' ESCAPE '\\' GROUP BY event_id""",
    "cache_split": _F + " SELECT f.doc_id, CASE"
        " WHEN f.doc_id % 7 <> 0 THEN quality END AS quality, coalesce(quality IS NOT NULL AND f.doc_id % 7 <> 0, false) AS cached FROM files f LEFT"
        " JOIN labels USING (doc_id)",
    "cache_upsert": _F + """, o AS (SELECT path, mtime, size, doc_id * 10 AS blur, CASE WHEN doc_id % 2 = 0 THEN md5 END AS md5 FROM files WHERE doc_id % 3 <> 0), n AS (SELECT path, mtime + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, size, CASE WHEN doc_id % 8 = 0 THEN doc_id * 11 END AS blur FROM files WHERE doc_id % 4 = 0)
      SELECT coalesce(o.path, n.path) AS path, coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.size, o.size) AS size, coalesce(n.blur, CASE WHEN n.path IS NULL OR n.mtime = o.mtime THEN o.blur END) AS blur, CASE WHEN n.path IS NULL OR n.mtime = o.mtime THEN o.md5 END AS md5 FROM o FULL JOIN n ON o.path = n.path""",
    "file_index": "WITH " + _INDEX + " SELECT base, ext, is_edited, count(*) AS n, min(path) AS first_path FROM idx GROUP BY base, ext, is_edited HAVING count(*) > 1",
    "index_lookup": "WITH " + _INDEX + ", held AS (SELECT base, ext, is_edited, min(path) AS path FROM idx WHERE event_id % 3 <> 0"
        " GROUP BY ALL), w AS (SELECT event_id, base, ext, event_id % 2 = 0 AS is_edited FROM idx WHERE event_id % 8 < 3)"
        " SELECT event_id, coalesce(s.path, o.path) AS found_path FROM w LEFT JOIN held s USING (base, ext, is_edited) LEFT"
        " JOIN held o ON w.base = o.base AND w.ext = o.ext AND w.is_edited = NOT o.is_edited",
    "insert_dedup": "WITH " + _INDEX + " SELECT event_id, base, ext, is_edited FROM idx i WHERE event_id % 3 <> 1 AND NOT EXISTS (FROM idx j"
        " WHERE j.event_id % 3 = 1 AND j.base = i.base AND j.ext = i.ext AND j.is_edited = i.is_edited)"
        " QUALIFY row_number() OVER (PARTITION BY base, ext, is_edited ORDER BY event_id) = 1",
    "collision_names": "WITH " + fx.CAPTURES + ", c AS (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y/%m'), name ORDER BY event_id) AS nth FROM captures) SELECT event_id, nth::INTEGER AS nth, " + _STEM + " || CASE WHEN nth > 1 THEN '_' || (nth - 1) ELSE '' END || regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS target FROM c",
    "project_folder_month": "WITH " + fx.CAPTURES + ", n AS (SELECT dir, strftime(ts, '%Y-%m-%d') AS month, count(*) AS n, min(event_id) AS seen FROM captures GROUP BY ALL) SELECT dir, month, n"
        " FROM n QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, seen) = 1",
    "folder_media_majority": "WITH " + fx.CAPTURES + ", k AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'video' WHEN event_id % 7 = 0 THEN 'other' ELSE 'photo' END AS kind FROM captures)"
        " SELECT dir, count_if(kind = 'video')::BIGINT AS videos, count_if(kind = 'photo')::BIGINT AS photos, min(ts) AS first_ts, bool_or(kind <> 'other') AS has_media,"
        " CASE WHEN count_if(kind = 'video') >= count_if(kind = 'photo') THEN 'Organized_Videos' ELSE 'Organized_Photos' END AS root FROM k"
        " GROUP BY dir",
    "import_routing": "WITH " + fx.CAPTURES + f""", s AS (SELECT *, {_STEM} AS stem FROM captures), d AS (SELECT *, {_LADDER} AS date FROM s),
      p AS (SELECT *, CASE WHEN name LIKE '1920x1080 %' THEN 'wallpaper' WHEN date IS NULL THEN 'review' ELSE 'organize' END AS kind FROM d), q AS (SELECT *, CASE kind WHEN 'wallpaper' THEN 'Wallpapers' WHEN 'review' THEN '_TO_REVIEW_' ELSE 'Organized_Photos' || strftime(date, '/%Y/%m %B') END AS place FROM p)
      SELECT event_id, place, CASE WHEN kind = 'organize' AND row_number() OVER (PARTITION BY place, name ORDER BY event_id) > 1 THEN 'skip_duplicate' ELSE kind END AS action FROM q""",
    "camcorder_routing": "WITH " + _MEASURED + """, i AS (SELECT DISTINCT l_shipdate, size, true AS indexed FROM probes WHERE file_no % 11 = 0), s AS (SELECT m.size, CASE WHEN NOT (ext = '.MTS' OR coalesce(codec IN ('h264', 'mpeg4'), false)) THEN 'skipped_codec' WHEN file_no % 101 = 0 THEN 'failed' WHEN indexed THEN 'skipped_indexed' WHEN bpp > 0.17 THEN 'convert_software' ELSE 'convert_hardware' END AS status FROM measured m LEFT JOIN i ON m.l_shipdate = i.l_shipdate AND m.size = i.size)
      SELECT status, count(*) AS n, sum(size)::BIGINT AS bytes FROM s GROUP BY status""",
    "triage_plan": "WITH " + NEAR + ", " + fx.FILES + """, found AS (SELECT event_id, bool_or(coalesce(neighbor_blur >= 40, false)) AS sharp FROM nearest GROUP BY event_id),
      b AS (SELECT count_if(blur < 30 AND coalesce(sharp, false))::BIGINT AS blurry, count_if(NOT (blur < 30 AND coalesce(sharp, false)))::BIGINT AS skipped FROM captures LEFT JOIN found USING (event_id) WHERE blur < 40 AND edge_density >= 0.02),
      t AS (SELECT (SELECT count(*) FROM captures) AS captures, (SELECT count(*) FROM files) AS files, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM files GROUP BY md5)) AS duplicates)
      SELECT *, captures + files - duplicates - blurry - skipped AS crisp_unique FROM t, b""",
    "review_assembly": "WITH " + NEAR.replace("pairs", "near_pairs") + ", " + _LISTING[len(fx.CAPTURES) + 2 :] + """, found AS (SELECT event_id, bool_or(coalesce(neighbor_blur >= 40, false)) AS sharp FROM nearest GROUP BY event_id),
      c AS (SELECT dir, name, blur, blur < 30 AND coalesce(sharp, false) AS safe FROM captures LEFT JOIN found USING (event_id) WHERE blur < 40 AND edge_density >= 0.02),
      repeated AS (SELECT dir, name FROM captures GROUP BY dir, name HAVING count(*) > 1)
      SELECT CASE WHEN safe THEN 'safe' ELSE 'review' END AS section, count(*) AS n, min(blur) AS least_blur FROM c WHERE (dir, name) NOT IN (SELECT (dir, name) FROM members) AND (dir, name) NOT IN (SELECT (dir, name) FROM repeated) GROUP BY section""",
    "undo_plan": _RANKED + " SELECT doc_id AS seq, 'Review/Duplicates/' || doc_id AS destination, path AS source, -doc_id AS step FROM k"
        " WHERE rank > 1 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0",
    "metadata_merge": "WITH " + fx.SIDECARS + """, m AS (SELECT s.*, least(taken, created) AS date, coalesce(abs((year(taken) - year(created)) * 12 + month(taken) - month(created)) >= 3, false) AS conflict, CASE WHEN event_id % 4 = 0 THEN taken END AS exif FROM sidecars s WHERE EXISTS (FROM media WHERE media.dir = s.dir AND media.name = s.original)),
      o AS (SELECT *, NOT conflict AND (abs(latitude) > 0.0001 OR abs(longitude) > 0.0001) AS place, date IS NOT DISTINCT FROM exif AS same FROM m)
      SELECT CASE WHEN same AND NOT place THEN 'unchanged' WHEN same THEN 'position' WHEN place THEN 'date and position' ELSE 'date' END AS outcome, conflict, count(*) AS n, min(date) AS first_date FROM o GROUP BY ALL""",
    "photo_directories": "WITH " + fx.CAPTURES + " SELECT 'lib/' || dir AS d, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM captures"
        " WHERE event_id % 50 <> 0 AND event_id % 51 <> 0 GROUP BY dir",
    "highres_photos": "WITH " + fx.CAPTURES + ", p AS (SELECT event_id, dir, size, array_to_string(string_split(" + _STEM + ", '_')[1:3], '_') AS stamp FROM captures WHERE event_id % 8 = 1), f AS (SELECT dir, stamp, min(stamp || '.MP_Robin.jpg') AS photo FROM p"
        " WHERE event_id % 3 = 0 AND size * 5 > 3 * 1024 * 1024 GROUP BY dir, stamp) SELECT event_id, photo FROM p LEFT JOIN f USING (dir, stamp)",
}
