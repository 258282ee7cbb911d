"""Plain SQL for each named query, for a second engine that reads the same tables.

The SQL starts from the tables again and uses arithmetic of its own, so it shares nothing with the
DataFrame code that it checks.
"""

from __future__ import annotations

_COMMON = """
raw_catch AS (
  SELECT rs.r_name AS source_authority, nc.n_name AS fishing_fleet,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS time_start,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS time_end,
         CASE WHEN l_suppkey % 20 = 7 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS codesource_area,
         p_brand AS gear_type, p_type AS species, l_linestatus AS fishing_mode,
         CASE l_linenumber WHEN 1 THEN 'MT' WHEN 2 THEN 'Tons' WHEN 3 THEN 't' WHEN 4 THEN 'NO'
                           WHEN 5 THEN 'Number of fish' WHEN 6 THEN 'no' ELSE 'HOOKS' END AS measurement_unit,
         CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS measurement_value,
         CASE l_returnflag WHEN 'N' THEN 'global_nominal_catch_firms_level0'
                           WHEN 'A' THEN 'global_catch_level1' ELSE 'global_catch_level2' END AS dataset
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN region rs ON ns.n_regionkey = rs.r_regionkey),
catch_rows AS (
  SELECT source_authority, fishing_fleet, time_start, codesource_area, gear_type, species, fishing_mode,
         CASE WHEN measurement_unit IN ('MT', 'Tons') THEN 't'
              WHEN measurement_unit IN ('NO', 'Number of fish') THEN 'no' ELSE measurement_unit END AS measurement_unit,
         TRY_CAST(measurement_value AS DOUBLE) AS measurement_value, dataset,
         CAST(year(CAST(time_start AS DATE)) AS INTEGER) AS year
  FROM raw_catch),
placed AS (
  SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS code,
         CAST((s_suppkey * 37) % 320 - 160 AS INTEGER) AS x0, CAST((s_suppkey * 17) % 140 - 70 AS INTEGER) AS y0,
         CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 20 END AS sz
  FROM supplier WHERE s_suppkey % 9 <> 5),
area_grid AS (
  SELECT code AS codesource_area,
         CASE k % 4 WHEN 0 THEN '1deg_x_1deg' WHEN 1 THEN '5deg_x_5deg' ELSE 'others' END AS gridtype,
         x0, y0, x0 + sz AS x1, y0 + sz AS y1,
         'POLYGON ((' || x0 || ' ' || y0 || ',' || (x0 + sz) || ' ' || y0 || ',' || (x0 + sz) || ' ' || (y0 + sz) || ','
           || x0 || ' ' || (y0 + sz) || ',' || x0 || ' ' || y0 || '))' AS geom_wkt
  FROM placed WHERE k % 4 <> 3),
area_nominal AS (
  SELECT code AS codesource_area, 'nominal' AS gridtype, x0, y0,
         'POLYGON ((' || x0 || ' ' || y0 || ',' || (x0 + 6) || ' ' || y0 || ',' || x0 || ' ' || (y0 + 6) || ','
           || x0 || ' ' || y0 || '))' AS geom_wkt
  FROM placed WHERE k % 4 = 3),
area_sources AS (
  SELECT codesource_area, gridtype, geom_wkt FROM area_grid
  UNION ALL SELECT codesource_area, gridtype, geom_wkt FROM area_nominal),
areas AS (
  SELECT codesource_area, gridtype, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin,
         CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax FROM area_grid
  UNION ALL
  SELECT codesource_area, gridtype, CAST(x0 + 1 AS DOUBLE), CAST(y0 + 1 AS DOUBLE), CAST(x0 + 3 AS DOUBLE),
         CAST(y0 + 3 AS DOUBLE) FROM area_nominal),
grouped AS (
  SELECT g.*, a.gridtype
  FROM (SELECT codesource_area, dataset, source_authority, species, gear_type, fishing_fleet, year, measurement_unit,
               COALESCE(SUM(measurement_value), 0.0) AS measurement_value
        FROM catch_rows WHERE codesource_area IS NOT NULL
        GROUP BY codesource_area, dataset, source_authority, species, gear_type, fishing_fleet, year, measurement_unit) g
  LEFT JOIN areas a ON g.codesource_area = a.codesource_area),
within_default AS (
  SELECT codesource_area FROM areas
  WHERE xmin >= -53.789063 AND xmax <= 98.964844 AND ymin >= -35.746512 AND ymax <= 21.616579),
within_second AS (
  SELECT codesource_area FROM areas WHERE xmin >= -160 AND xmax <= 20 AND ymin >= -75 AND ymax <= 60),
listed_any_unit AS (
  SELECT * FROM grouped
  WHERE species IN ('PROMO', 'SMALL', 'ECONOMY') AND year BETWEEN 1996 AND 1999
    AND gridtype IN ('1deg_x_1deg', '5deg_x_5deg', 'others') AND gear_type <> 'Brand#1'
    AND CAST(replace(fishing_fleet, 'NATION_', '') AS INTEGER) < 15),
listed AS (SELECT * FROM listed_any_unit WHERE measurement_unit = 't'),
narrow AS (SELECT * FROM listed WHERE species = 'PROMO' AND year IN (1997, 1998)),
cells AS (
  SELECT codesource_area, dataset, measurement_unit, SUM(measurement_value) AS measurement_value
  FROM listed GROUP BY ALL),
plot_two AS (
  SELECT dataset, year, gridtype, measurement_unit, SUM(measurement_value) AS measurement_value
  FROM listed_any_unit WHERE measurement_unit IN ('t', 'no') GROUP BY ALL),
series AS (
  SELECT dataset, year, measurement_unit, SUM(measurement_value) AS measurement_value
  FROM listed_any_unit GROUP BY ALL),
gear_series AS (
  SELECT measurement_unit, gear_type, year, species, SUM(measurement_value) AS measurement_value
  FROM grouped GROUP BY ALL),
manifest AS (
  SELECT '10.5281/zenodo.' || CAST(doc_id AS VARCHAR) AS doi, CAST(doc_id AS VARCHAR) AS record_id,
         'global_catch_' || source || '_' || lang AS stem,
         CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'zip' ELSE 'qs' END AS mime
  FROM documents),
records AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id,
         CASE WHEN quality = 1 THEN 'title-' || CAST(doc_id AS VARCHAR) END AS title, 'id-' || CAST(toxic AS VARCHAR) AS identifier
  FROM labels),
drawn AS (
  SELECT event_id, CAST((event_id * 7) % 300 - 150 AS INTEGER) AS x0, CAST((event_id * 11) % 120 - 60 AS INTEGER) AS y0,
         CAST((event_id * 7) % 300 - 150 + 1 + event_id % 20 AS INTEGER) AS x1,
         CAST((event_id * 11) % 120 - 60 + 1 + event_id % 13 AS INTEGER) AS y1
  FROM events),
fleet_labels AS (
  SELECT code, CASE WHEN CAST(replace(code, 'NATION_', '') AS INTEGER) IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 = 0)
                    THEN code ELSE 'Fleet ' || code END AS label
  FROM (SELECT DISTINCT fishing_fleet AS code FROM grouped)),
gear_labels AS (
  SELECT code, CASE WHEN code = 'Brand#3' THEN code ELSE 'Gear ' || code END AS label
  FROM (SELECT DISTINCT gear_type AS code FROM grouped)),
species_labels AS (
  SELECT code, CASE WHEN code IN ('STANDARD', 'LARGE') THEN 'Unknown (required for effort)' ELSE 'Taxon ' || code END AS label
  FROM (SELECT DISTINCT species AS code FROM grouped)),
authority_labels AS (
  SELECT code, code || ' - Commission ' || code AS label FROM (SELECT DISTINCT source_authority AS code FROM grouped)),
unit_labels AS (
  SELECT code, CASE code WHEN 't' THEN 'Tons of fish (catch unit)' WHEN 'no' THEN 'Number of fish (catch unit)' ELSE code END AS label
  FROM (SELECT DISTINCT measurement_unit AS code FROM grouped)),
labels_all AS (
  SELECT 'fishing_fleet' AS dimension, code, label, label AS sort_label FROM fleet_labels
  UNION ALL SELECT 'gear_type', code, label, label FROM gear_labels
  UNION ALL SELECT 'species', code, label, CASE WHEN code = 'STANDARD' THEN code ELSE 'Label ' || code END FROM species_labels
  UNION ALL SELECT 'source_authority', code, label, code FROM authority_labels
  UNION ALL SELECT 'measurement_unit', code, label, label FROM unit_labels
  UNION ALL SELECT 'dataset', dataset, dataset, dataset FROM (SELECT DISTINCT dataset FROM grouped))
"""

_FACET_PAIRS = """
  SELECT DISTINCT 'dataset' AS dimension, dataset AS value FROM {rows}
  UNION ALL SELECT DISTINCT 'gridtype', gridtype FROM {rows}
  UNION ALL SELECT DISTINCT 'species', species FROM {rows}
  UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM {rows}
  UNION ALL SELECT DISTINCT 'gear_type', gear_type FROM {rows}
  UNION ALL SELECT DISTINCT 'measurement_unit', measurement_unit FROM {rows}
  UNION ALL SELECT DISTINCT 'source_authority', source_authority FROM {rows}
  UNION ALL SELECT DISTINCT 'fishing_fleet', fishing_fleet FROM {rows}
"""

_KEYS = (
    "codesource_area, dataset, source_authority, species, gear_type, fishing_fleet, year, measurement_unit, "
    "gridtype, measurement_value"
)

_DATASETS = ("global_nominal_catch_firms_level0", "global_catch_level1", "global_catch_level2")

_WIDE = ", ".join(
    f"""CAST(COALESCE(SUM(CASE WHEN dataset = '{d}' THEN trunc(measurement_value) END), 0) AS INTEGER) AS "{d}\""""
    for d in _DATASETS
)

_BY_DATE = ", ".join(
    f"""CASE WHEN COUNT(*) FILTER (WHERE measurement_unit = '{u}') > 0
             THEN COALESCE(SUM(CASE WHEN dataset = '{d}' AND measurement_unit = '{u}' THEN measurement_value END), 0.0)
        END AS "{d}_{u}\""""
    for u in ("t", "no")
    for d in _DATASETS
)

_GRID_TEXT = "x0 || ' ' || y0 || ',' || x0 || ' ' || y1 || ','"

_SQL = {
    # ---- ingest
    "harmonise_layouts": """
        SELECT source_authority, fishing_fleet, time_start, time_end, codesource_area, gear_type, species, fishing_mode,
               measurement_unit, measurement_value, dataset FROM raw_catch""",
    "union_datasets": "SELECT dataset, COUNT(*) AS count FROM raw_catch GROUP BY dataset",
    "manifest_derive": """
        SELECT doi, record_id, stem AS filename, mime AS file_mime, 'https://doi.org/' || doi AS url,
               '[![DOI](https://zenodo.org/badge/DOI/' || doi || '.svg)](https://doi.org/' || doi || ')' AS badge,
               stem || '_' || record_id AS code, stem || '_' || record_id || '.' || mime AS newname
        FROM manifest""",
    "dataset_provenance": """
        SELECT '/data/' || stem || '_' || record_id || '.' || mime AS filename, stem || '_' || record_id AS dataset
        FROM manifest""",
    "manifest_enrich": """
        SELECT record_id, COALESCE(title, '') AS title, COALESCE(identifier, '') AS identifier
        FROM manifest LEFT JOIN records USING (record_id)""",
    "manifest_table": """
        SELECT COALESCE(identifier, '') AS identifier, COALESCE(title, '') AS title, doi, stem || '.' || mime AS filename,
               'https://doi.org/' || doi AS url
        FROM manifest LEFT JOIN records USING (record_id)""",
    "year_extract": """
        SELECT dataset, CAST(substr(time_start, 1, 4) AS INTEGER) AS year, COUNT(*) AS count
        FROM raw_catch GROUP BY ALL""",
    "unit_normalise": """
        SELECT measurement_unit AS raw_unit,
               CASE measurement_unit WHEN 'MT' THEN 't' WHEN 'Tons' THEN 't' WHEN 'NO' THEN 'no'
                                     WHEN 'Number of fish' THEN 'no' ELSE measurement_unit END AS unit,
               COUNT(*) AS count
        FROM raw_catch GROUP BY measurement_unit""",
    "measure_cast": """
        SELECT dataset, COUNT(*) AS n_rows, COUNT(TRY_CAST(measurement_value AS DOUBLE)) AS n_valid,
               COALESCE(SUM(TRY_CAST(measurement_value AS DOUBLE)), 0.0) AS total
        FROM raw_catch GROUP BY dataset""",
    "drop_null_area": """
        SELECT dataset, COUNT(*) AS count FROM raw_catch WHERE codesource_area IS NOT NULL GROUP BY dataset""",
    # ---- areas
    "gridtype_recode": "SELECT codesource_area AS code, gridtype FROM area_grid",
    "wkt_ring": """
        SELECT codesource_area, 5 AS n_points, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin,
               CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax FROM area_grid
        UNION ALL
        SELECT codesource_area, 4, CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(x0 + 6 AS DOUBLE), CAST(y0 + 6 AS DOUBLE)
        FROM area_nominal""",
    "area_dim": """
        SELECT codesource_area, gridtype, CAST(row_number() OVER (ORDER BY codesource_area, gridtype) AS INTEGER) AS ogc_fid,
               xmin, ymin, xmax, ymax FROM areas""",
    "areas_used": """
        SELECT codesource_area, gridtype FROM area_grid
        WHERE codesource_area IN (SELECT codesource_area FROM raw_catch WHERE codesource_area IS NOT NULL)""",
    "areas_from_facts": """
        SELECT a.codesource_area, a.gridtype, a.geom_wkt, CAST(MIN(l_orderkey) AS INTEGER) AS ogc_fid
        FROM lineitem JOIN area_sources a ON a.codesource_area = CAST(l_suppkey AS VARCHAR) AND l_suppkey % 20 <> 7
        GROUP BY ALL""",
    "areas_from_facts_within": """
        SELECT DISTINCT a.codesource_area
        FROM (SELECT codesource_area, x0, y0, x1, y1 FROM area_grid
              UNION ALL SELECT codesource_area, x0, y0, x0 + 6, y0 + 6 FROM area_nominal) a
        JOIN lineitem ON a.codesource_area = CAST(l_suppkey AS VARCHAR) AND l_suppkey % 20 <> 7
        WHERE x0 >= -53.789063 AND x1 <= 98.964844 AND y0 >= -35.746512 AND y1 <= 21.616579""",
    "nominal_disc": """
        SELECT codesource_area, CAST(x0 + 2 AS DOUBLE) AS cx, CAST(y0 + 2 AS DOUBLE) AS cy, 121 AS n_points
        FROM area_nominal""",
    "geom_ewkt_text": "SELECT codesource_area, 'SRID=4326;' || geom_wkt AS geom FROM area_sources",
    "geom_first_part": """
        SELECT codesource_area, 'POLYGON ((' || x0 || ' ' || y0 || ',' || (x0 + 1) || ' ' || y0 || ',' || (x0 + 1) || ' '
               || (y0 + 1) || ',' || x0 || ' ' || (y0 + 1) || ',' || x0 || ' ' || y0 || '))' AS geom_wkt
        FROM area_grid""",
    "geom_explode_parts": """
        SELECT codesource_area, part, 'POLYGON ((' || x || ' ' || y0 || ',' || (x + 1) || ' ' || y0 || ',' || (x + 1) || ' '
               || (y0 + 1) || ',' || x || ' ' || (y0 + 1) || ',' || x || ' ' || y0 || '))' AS geom_wkt
        FROM (SELECT code AS codesource_area, y0, i + 1 AS part, x0 + 2 * i AS x
              FROM placed JOIN (VALUES (0), (1), (2)) v(i) ON i <= k % 3 WHERE k % 4 <> 3)""",
    # ---- spatial
    "areas_within_rect": "SELECT codesource_area FROM within_default",
    "areas_within_polygon": """
        SELECT codesource_area FROM areas
        WHERE xmin >= -160 AND xmax <= 160 AND ymin >= -70 AND ymax <= 70
          AND NOT (xmax > -60 AND xmin < 40 AND ymax > -20)""",
    "areas_within_holed": """
        SELECT codesource_area FROM areas
        WHERE ymin >= -70 AND ymax <= 70 AND (xmin >= -160 AND xmax <= 60 OR xmin >= 80 AND xmax <= 160)
          AND codesource_area NOT IN (
            SELECT codesource_area FROM area_grid WHERE x1 > -100 AND x0 < -20 AND y1 > -30 AND y0 < 40
            UNION ALL
            SELECT codesource_area FROM area_nominal
            WHERE x0 + 2 > -101 AND x0 + 2 < -19 AND y0 + 2 BETWEEN -30 AND 40
               OR y0 + 2 > -31 AND y0 + 2 < 41 AND x0 + 2 BETWEEN -100 AND -20)""",
    "facts_within": f"""
        SELECT {_KEYS} FROM grouped WHERE codesource_area IN (SELECT codesource_area FROM within_default)""",
    "geojson_rect_wkt": """
        SELECT event_id, 'POLYGON ((' || x0 || ' ' || y1 || ',' || x1 || ' ' || y1 || ',' || x1 || ' ' || y0 || ','
               || x0 || ' ' || y0 || ',' || x0 || ' ' || y1 || '))' AS wkt FROM drawn""",
    "selection_centre": "SELECT event_id, (x0 + x1) / 2.0::DOUBLE AS lon, (y0 + y1) / 2.0::DOUBLE AS lat FROM drawn",
    "selection_disjoint": """
        SELECT event_id FROM drawn d
        WHERE NOT EXISTS (SELECT 1 FROM area_grid a
                          WHERE a.x0 <= d.x1 AND a.x1 >= d.x0 AND a.y0 <= d.y1 AND a.y1 >= d.y0)
          AND NOT EXISTS (SELECT 1 FROM area_nominal n
                          WHERE pow(greatest(d.x0 - (n.x0 + 2), (n.x0 + 2) - d.x1, 0), 2)
                              + pow(greatest(d.y0 - (n.y0 + 2), (n.y0 + 2) - d.y1, 0), 2) <= 1)""",
    "footprint_text": """
        SELECT codesource_area, 'MULTIPOLYGON (' || replace(geom_wkt, 'POLYGON ', '') || ')' AS footprint
        FROM area_grid WHERE codesource_area IN (SELECT codesource_area FROM listed)""",
    "hull_centre": """
        SELECT round(SUM((px + qx) * c) / (3 * SUM(c)), 6) AS lon, round(SUM((py + qy) * c) / (3 * SUM(c)), 6) AS lat
        FROM (
          WITH corners AS (
            SELECT x0 AS x, y0 AS y FROM area_grid UNION SELECT x1, y0 FROM area_grid UNION SELECT x1, y1 FROM area_grid
            UNION SELECT x0, y1 FROM area_grid
            UNION SELECT round(x0 + 2 + cos(i * pi() / 60), 6), round(y0 + 2 + sin(i * pi() / 60), 6)
                  FROM area_nominal JOIN range(120) r(i) ON TRUE),
          ends AS (
            SELECT x, MIN(y) AS y FROM corners GROUP BY x UNION SELECT x, MAX(y) FROM corners GROUP BY x),
          reach AS (
            SELECT x, y, MIN(y) OVER before AS lo1, MAX(y) OVER before AS hi1, MIN(y) OVER after AS lo2, MAX(y) OVER after AS hi2
            FROM ends
            WINDOW before AS (ORDER BY x GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   after AS (ORDER BY x GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
          outer_points AS (
            SELECT x, y FROM reach
            WHERE lo1 IS NULL OR lo2 IS NULL OR y <= lo1 OR y >= hi1 OR y <= lo2 OR y >= hi2)
          SELECT a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, a.x * b.y - b.x * a.y AS c
          FROM outer_points a JOIN outer_points b ON a.x <> b.x OR a.y <> b.y
          WHERE NOT EXISTS (
            SELECT 1 FROM outer_points p
            WHERE (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0
               OR ((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) = 0
                   AND (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) > 0))
        )""",
    # ---- grouped fact and selections
    "grouped_fact": f"SELECT {_KEYS} FROM grouped",
    "filter_eight_dims": f"SELECT {_KEYS} FROM listed",
    "filter_regroup": f"SELECT {_KEYS} FROM listed",
    "filter_with_polygon": f"""
        SELECT {_KEYS} FROM listed WHERE codesource_area IN (SELECT codesource_area FROM within_default)""",
    "fallback_spatial": f"SELECT {_KEYS}, 'spatial_fallback' AS status FROM listed",
    "fallback_dims": f"""
        SELECT {_KEYS}, 'dimension_fallback' AS status FROM listed
        WHERE codesource_area IN (SELECT codesource_area FROM within_default)""",
    "refine_polygon_only": f"""
        SELECT {_KEYS} FROM listed WHERE codesource_area IN (SELECT codesource_area FROM within_second)""",
    "refine_subset": f"""
        SELECT {_KEYS} FROM narrow WHERE codesource_area IN (SELECT codesource_area FROM within_default)""",
    "back_to_last_polygon": f"""
        SELECT {_KEYS} FROM listed
        WHERE year IN (1997, 1998) AND codesource_area IN (SELECT codesource_area FROM within_default)""",
    "reset_all": "SELECT gridtype, COUNT(*) AS count FROM grouped GROUP BY gridtype",
    "refine_chain": f"""
        SELECT {_KEYS}, 'applied' AS status FROM grouped
        WHERE species IN ('PROMO', 'SMALL', 'ECONOMY') AND year BETWEEN 1996 AND 1999 AND measurement_unit = 't'
          AND gridtype IN ('1deg_x_1deg', '5deg_x_5deg', 'others') AND gear_type <> 'Brand#1'
          AND CAST(replace(fishing_fleet, 'NATION_', '') AS INTEGER) < 14
          AND codesource_area IN (SELECT codesource_area FROM within_second)""",
    "reset_listed": "SELECT gridtype, COUNT(*) AS count FROM grouped GROUP BY gridtype",
    "drawn_vs_footprint": """
        SELECT event_id FROM drawn d
        WHERE NOT EXISTS (SELECT 1 FROM area_grid a
                          WHERE a.codesource_area IN (SELECT codesource_area FROM listed)
                            AND a.x0 <= d.x1 AND a.x1 >= d.x0 AND a.y0 <= d.y1 AND a.y1 >= d.y0)""",
    "dataset_facet": """
        SELECT code, code AS label, title, identifier, url
        FROM (SELECT DISTINCT dataset AS code FROM grouped)
        LEFT JOIN (SELECT stem || '_' || m.record_id AS code, COALESCE(title, '') AS title, COALESCE(identifier, '') AS identifier,
                          'https://doi.org/' || doi AS url FROM manifest m LEFT JOIN records r ON m.record_id = r.record_id) USING (code)""",
    "drawings_disjoint": """
        SELECT event_id FROM drawn d
        WHERE NOT EXISTS (SELECT 1 FROM area_grid a
                          WHERE a.x0 <= d.x1 + 3 AND a.x1 >= d.x0 - 3 AND a.y0 <= d.y1 + 3 AND a.y1 >= d.y0 - 3
                            AND NOT (a.x0 > d.x0 AND a.x1 < d.x1 AND a.y0 > d.y0 AND a.y1 < d.y1))
          AND NOT EXISTS (SELECT 1 FROM area_nominal n
                          WHERE pow(greatest(d.x0 - 3 - (n.x0 + 2), (n.x0 + 2) - d.x1 - 3, 0), 2)
                              + pow(greatest(d.y0 - 3 - (n.y0 + 2), (n.y0 + 2) - d.y1 - 3, 0), 2) <= 1
                            AND NOT (n.x0 + 1 > d.x0 AND n.x0 + 3 < d.x1 AND n.y0 + 1 > d.y0 AND n.y0 + 3 < d.y1))""",
    "reset_polygon": f"SELECT {_KEYS} FROM listed",
    "values_added": f"""
        SELECT * FROM ({_FACET_PAIRS.format(rows="listed")})
        EXCEPT SELECT * FROM ({_FACET_PAIRS.format(rows="narrow")})""",
    # ---- facets
    "facet_combinations": """
        SELECT dataset, gridtype, species, year, gear_type, measurement_unit, source_authority, fishing_fleet,
               COUNT(*) AS count FROM grouped GROUP BY ALL""",
    "facet_values": _FACET_PAIRS.format(rows="grouped"),
    "facet_year_gridtype": """
        SELECT 'year' AS dimension, CAST(year AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS pos
        FROM (SELECT DISTINCT year FROM grouped WHERE year IS NOT NULL)
        UNION ALL
        SELECT 'gridtype', gridtype, CAST(row_number() OVER (ORDER BY gridtype) AS INTEGER)
        FROM (SELECT DISTINCT gridtype FROM grouped WHERE gridtype IS NOT NULL)""",
    "facet_labels": """
        SELECT dimension, code, label FROM labels_all
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), CAST(year AS VARCHAR)
                  FROM (SELECT DISTINCT year FROM grouped WHERE year IS NOT NULL)
        UNION ALL SELECT 'gridtype', gridtype, gridtype
                  FROM (SELECT DISTINCT gridtype FROM grouped WHERE gridtype IS NOT NULL)""",
    "facet_order": """
        SELECT dimension, code, label,
               CAST(row_number() OVER (PARTITION BY dimension ORDER BY lower(sort_label), sort_label, code) AS INTEGER) AS pos
        FROM labels_all""",
    "facet_dependent": _FACET_PAIRS.format(rows="(SELECT * FROM grouped WHERE species = 'PROMO')"),
    "facet_choosable": """
        SELECT * FROM (
        WITH c AS (SELECT *, species = 'PROMO' AS s, year IN (1997, 1998) AS y, measurement_unit = 't' AS u FROM grouped),
        k AS (SELECT * FROM c WHERE s AND y AND u)
        SELECT DISTINCT 'species' AS dimension, species AS value FROM c WHERE y AND u
        UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM c WHERE s AND u
        UNION ALL SELECT DISTINCT 'measurement_unit', measurement_unit FROM c WHERE s AND y
        UNION ALL SELECT DISTINCT 'dataset', dataset FROM k
        UNION ALL SELECT DISTINCT 'gridtype', gridtype FROM k
        UNION ALL SELECT DISTINCT 'gear_type', gear_type FROM k
        UNION ALL SELECT DISTINCT 'source_authority', source_authority FROM k
        UNION ALL SELECT DISTINCT 'fishing_fleet', fishing_fleet FROM k)""",
    "codelist_join": "SELECT code, label FROM fleet_labels",
    "species_facet": "SELECT code, label FROM species_labels",
    "gear_facet": "SELECT code, label FROM gear_labels",
    "authority_facet": "SELECT code, label FROM authority_labels",
    "taxon_id_join": """
        SELECT code, taxon_scientific_name,
               (SELECT CAST(MAX(p_partkey) + 1000 AS INTEGER) FROM part WHERE 'Taxon ' || p_type = taxon_scientific_name) AS aphia_id
        FROM (SELECT DISTINCT p_type AS code, CASE WHEN p_type <> 'LARGE' THEN 'Taxon ' || p_type END AS taxon_scientific_name
              FROM part WHERE p_type <> 'STANDARD')""",
    # ---- views
    "flagship": """
        SELECT c.codesource_area, dataset, measurement_unit, measurement_value, gridtype, xmin, ymin, xmax, ymax
        FROM cells c JOIN areas a ON c.codesource_area = a.codesource_area
        WHERE c.codesource_area IN (SELECT codesource_area FROM within_default)""",
    "map_view": """
        SELECT c.codesource_area, dataset, measurement_unit, measurement_value, gridtype, xmin, ymin, xmax, ymax
        FROM cells c LEFT JOIN areas a ON c.codesource_area = a.codesource_area""",
    "map_layer_counts": "SELECT dataset, COUNT(*) AS count FROM cells GROUP BY dataset",
    "map_labels": """
        SELECT codesource_area, dataset,
               'Captures pour cette espece: ' || CAST(CAST(round_even(measurement_value, 0) AS BIGINT) AS VARCHAR) || ' tonnes(t)' AS label
        FROM cells""",
    "map_deciles": """
        SELECT codesource_area, dataset, measurement_value,
               CAST(1 + (SELECT COUNT(*)
                         FROM (SELECT unnest(quantile_cont(measurement_value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS b FROM cells)
                         WHERE round(b, 6) <= c.measurement_value) AS INTEGER) AS decile
        FROM cells c""",
    "plot_view": """
        SELECT dataset, year, gridtype, measurement_unit, SUM(measurement_value) AS measurement_value
        FROM listed GROUP BY ALL""",
    "series_long": "SELECT dataset, year, measurement_unit, measurement_value FROM series",
    "series_wide": f"SELECT year, measurement_unit, {_WIDE} FROM series GROUP BY year, measurement_unit",
    "series_dense": """
        SELECT k.dataset || '_' || k.measurement_unit AS series_name, k.measurement_unit, k.dataset, y.year,
               CAST(COALESCE(trunc(s.measurement_value), 0) AS INTEGER) AS measurement_value
        FROM (SELECT dataset, measurement_unit FROM series GROUP BY ALL HAVING SUM(trunc(measurement_value)) > 0) k
        CROSS JOIN (SELECT DISTINCT year FROM series) y
        LEFT JOIN series s ON s.dataset = k.dataset AND s.measurement_unit = k.measurement_unit AND s.year = y.year""",
    "series_dense_undated": """
        SELECT * FROM (WITH undated AS (
          SELECT dataset, measurement_unit, CASE WHEN year <> 1998 THEN year END AS year, trunc(SUM(measurement_value)) AS v
          FROM listed_any_unit GROUP BY ALL)
        SELECT k.dataset || '_' || k.measurement_unit AS series_name, k.measurement_unit, k.dataset, y.year,
               CAST(COALESCE(s.v, 0) AS INTEGER) AS measurement_value
        FROM (SELECT dataset, measurement_unit FROM undated GROUP BY ALL HAVING SUM(v) > 0) k
        CROSS JOIN (SELECT DISTINCT year FROM undated) y
        LEFT JOIN undated s ON s.dataset = k.dataset AND s.measurement_unit = k.measurement_unit
                           AND s.year IS NOT DISTINCT FROM y.year)""",
    "series_date_one_unit": f"""
        SELECT make_date(year, 1, 1) AS date, {", ".join(
            f"COALESCE(SUM(CASE WHEN dataset = '{d}' THEN measurement_value END), 0.0) AS \"{d}\"" for d in _DATASETS)}
        FROM series WHERE measurement_unit = 'HOOKS' GROUP BY year""",
    "series_date_merge": f"""
        SELECT make_date(year, 1, 1) AS date, {_BY_DATE} FROM series WHERE measurement_unit IN ('t', 'no') GROUP BY year""",
    "gridtype_totals": """
        SELECT dataset, gridtype, measurement_unit, SUM(measurement_value) AS measurement_value, COUNT(*) AS count
        FROM plot_two GROUP BY ALL""",
    "gridtype_share": """
        SELECT dataset, gridtype, measurement_unit, measurement_value,
               round(measurement_value / nullif(SUM(measurement_value) OVER (PARTITION BY dataset), 0), 6) AS share
        FROM (SELECT dataset, gridtype, measurement_unit, SUM(measurement_value) AS measurement_value
              FROM plot_two WHERE measurement_unit = 'no' GROUP BY ALL)""",
    "dataset_unit_totals": """
        SELECT dataset, measurement_unit, SUM(measurement_value) AS measurement_value, COUNT(*) AS count
        FROM plot_two GROUP BY ALL""",
    "dataset_totals": "SELECT dataset, SUM(measurement_value) AS measurement_value FROM plot_two GROUP BY dataset",
    "totals_wide": """
        SELECT dataset,
               COALESCE(SUM(measurement_value) FILTER (WHERE measurement_unit = 'no'), 0) AS measurement_value_no,
               COALESCE(SUM(measurement_value) FILTER (WHERE measurement_unit = 't'), 0) AS measurement_value_t,
               COUNT(*) FILTER (WHERE measurement_unit = 'no') AS count_no,
               COUNT(*) FILTER (WHERE measurement_unit = 't') AS count_t
        FROM plot_two GROUP BY dataset""",
    "bar_tons_only": """
        SELECT dataset, measurement_unit, SUM(measurement_value) AS measurement_value
        FROM plot_two WHERE measurement_unit = 't' GROUP BY ALL""",
    "ratio_to_baseline": """
        SELECT dataset, round(SUM(measurement_value) / (SELECT SUM(measurement_value) FROM plot_two
                                                         WHERE dataset = 'global_nominal_catch_firms_level0'), 6) AS ratio
        FROM plot_two WHERE dataset <> 'global_nominal_catch_firms_level0' GROUP BY dataset""",
    "ratio_share": """
        SELECT dataset, round(SUM(measurement_value) / SUM(SUM(measurement_value)) OVER (), 6) AS share
        FROM plot_two WHERE dataset <> 'global_nominal_catch_firms_level0' GROUP BY dataset""",
    "gear_species_series": "SELECT measurement_unit, gear_type, year, species, measurement_value FROM gear_series",
    "gear_totals": """
        SELECT measurement_unit, gear_type, SUM(measurement_value) AS measurement_value FROM gear_series GROUP BY ALL""",
    "gear_totals_sorted": """
        SELECT row_number() OVER (ORDER BY measurement_unit, gear_type) AS pos, measurement_unit, gear_type, measurement_value
        FROM (SELECT measurement_unit, gear_type, SUM(measurement_value) AS measurement_value FROM gear_series GROUP BY ALL)""",
    "fact_by_parts": """
        SELECT dataset, COUNT(*) AS n_rows, SUM(measurement_value) AS total FROM grouped GROUP BY dataset""",
    "top_gears_by_code": "SELECT DISTINCT gear_type FROM grouped ORDER BY gear_type DESC LIMIT 9",
    "top_gears_by_total": """
        SELECT gear_type, measurement_value
        FROM (SELECT gear_type, SUM(measurement_value) AS measurement_value, rank() OVER (ORDER BY SUM(measurement_value) DESC) AS r
              FROM gear_series GROUP BY gear_type) WHERE r <= 9""",
    "top_gear_series": """
        SELECT gear_type, measurement_unit, year, species, measurement_value FROM gear_series
        WHERE gear_type IN (SELECT gear_type FROM (SELECT DISTINCT gear_type FROM grouped) ORDER BY gear_type DESC LIMIT 9)""",
    "top_rows": f"""
        SELECT {_KEYS}, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, rank() OVER (ORDER BY measurement_value DESC) AS rank FROM listed
              WHERE codesource_area IN (SELECT codesource_area FROM within_default)) WHERE rank <= 10""",
    "top_rows_fractional": """
        SELECT codesource_area, species, CAST(round(v, 2) AS DOUBLE) AS measurement_value, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, rank() OVER (ORDER BY v DESC) AS r FROM (
              SELECT CAST(l_suppkey AS VARCHAR) AS codesource_area, p_type AS species,
                     SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 9))) AS v
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE r <= 10""",
    "top_gears_fractional": """
        SELECT gear_type, CAST(round(v, 2) AS DOUBLE) AS measurement_value
        FROM (SELECT *, rank() OVER (ORDER BY v DESC) AS r FROM (
              SELECT p_brand AS gear_type, SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 9))) AS v
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE r <= 9""",
    "map_deciles_fractional": """
        SELECT * FROM (WITH sums AS (
          SELECT CAST(l_suppkey AS VARCHAR) AS codesource_area, p_type AS dataset,
                 CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 9))) AS DOUBLE) AS v
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        breaks AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS b FROM sums)
        SELECT codesource_area, dataset, CAST(1 + len(list_filter(b, lambda x: x <= v)) AS INTEGER) AS decile
        FROM sums, breaks)""",
}


def all_reference_sql() -> dict[str, str]:
    return {name: f"WITH {_COMMON.strip()}\n{body.strip()}" for name, body in _SQL.items()}
