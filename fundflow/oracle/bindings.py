"""The test-data binding written independently in DuckDB SQL (the oracle side).

``with_views(body, *names)`` prefixes a query with the CTEs it needs, in
dependency order. Every view reads the pre-registered base tables.
"""

from __future__ import annotations

CYCLE = "CAST(YEAR({t}) + YEAR({t}) % 2 AS INTEGER)"

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("candidates", [], f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS candidate_id, c.c_name AS name,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'H' WHEN 'BUILDING' THEN 'S' WHEN 'AUTOMOBILE' THEN 'P' END AS office,
  LPAD(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS state,
  CAST(c.c_custkey % 20 AS VARCHAR) AS district,
  CASE c.c_custkey % 4 WHEN 0 THEN 'DEM' WHEN 1 THEN 'REP' WHEN 2 THEN 'DFL' END AS party,
  CASE c.c_custkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'C' ELSE 'O' END AS incumbent_challenge,
  COALESCE(o.cycles, []) AS cycles, o.first_file_date, o.last_file_date,
  c.c_mktsegment || ' PARTY' AS party_full,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Incumbent' WHEN 1 THEN 'Challenger' ELSE 'Open seat' END AS incumbent_challenge_full,
  SUBSTRING(c.c_mktsegment, 1, 1) AS candidate_status, CAST(YEAR(o.last_file_date) AS INTEGER) AS active_through,
  list_transform(COALESCE(o.cycles, []), lambda y: y + 2) AS election_years,
  c.c_acctbal < 0 AS federal_funds_flag, c.c_acctbal > 5000 AS has_raised_funds
FROM customer c LEFT JOIN (
  SELECT o_custkey,
    CAST(MIN(o_orderdate) AS DATE) AS first_file_date,
    CAST(MAX(o_orderdate) AS DATE) AS last_file_date,
    list_sort(list(DISTINCT {CYCLE.format(t='o_orderdate')})) AS cycles
  FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
""")

# registry of the candidates table: the source's default office filter (P, S, H)
view("registered", ["candidates"], "SELECT * FROM candidates WHERE office IN ('P', 'S', 'H')")

view("inside_raw", [], f"""
SELECT CAST(o_custkey AS VARCHAR) AS candidate_id,
  {CYCLE.format(t='o_orderdate')} AS cycle,
  CAST(o_totalprice AS DECIMAL(15,2)) AS receipts,
  CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(15,2))
                     WHEN 'O' THEN CAST(0 AS DECIMAL(15,2)) END AS disbursements,
  o_orderkey AS seq
FROM orders
""")

view("inside_t", ["inside_raw"], """
SELECT candidate_id, cycle,
  CAST(SUM(COALESCE(receipts, 0)) AS DECIMAL(15,2)) AS receipts,
  CAST(SUM(COALESCE(disbursements, 0)) AS DECIMAL(15,2)) AS disbursements
FROM inside_raw
WHERE COALESCE(candidate_id, '') <> '' AND COALESCE(cycle, 0) <> 0
GROUP BY candidate_id, cycle
""")

view("outside_raw", [], f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS candidate_id,
  {CYCLE.format(t='l.l_shipdate')} AS cycle,
  CASE l.l_returnflag WHEN 'A' THEN (CASE WHEN l.l_linenumber % 3 = 0 THEN 'S' ELSE 's' END) WHEN 'R' THEN 'O' END AS support_oppose_indicator,
  CAST(l.l_extendedprice AS DECIMAL(14,2)) AS total,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")

view("outside_first", ["outside_raw"], """
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (
    PARTITION BY candidate_id, cycle, support_oppose_indicator
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS first_rank
  FROM outside_raw
  WHERE COALESCE(candidate_id, '') <> '' AND COALESCE(cycle, 0) <> 0
    AND COALESCE(support_oppose_indicator, '') <> '')
WHERE first_rank = 1
""")

# the store keeps one row per clean key: of raw keys that differ in case, the one that came last
view("outside_t", ["outside_first"], """
SELECT candidate_id, cycle, indicator AS support_oppose_indicator, total FROM (
  SELECT *, UPPER(support_oppose_indicator) AS indicator, ROW_NUMBER() OVER (
    PARTITION BY candidate_id, cycle, UPPER(support_oppose_indicator)
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS last_rank
  FROM outside_first WHERE UPPER(support_oppose_indicator) IN ('S', 'O'))
WHERE last_rank = 1
""")


# every row that the store applies, with its number among the rows of its key and the total before it
view("outside_writes", ["outside_first"], """
SELECT candidate_id, cycle, UPPER(support_oppose_indicator) AS support_oppose_indicator, total,
  ROW_NUMBER() OVER of_key AS n, LAG(total) OVER of_key AS before
FROM outside_first WHERE UPPER(support_oppose_indicator) IN ('S', 'O')
WINDOW of_key AS (PARTITION BY candidate_id, cycle, UPPER(support_oppose_indicator)
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
""")


def ratio_sql(n: str, d: str) -> str:
    """ROUND(n / NULLIF(d, 0), 2) half away from zero, exactly, in integer cents -> DOUBLE."""
    nc, dc = f"CAST(({n}) * 100 AS HUGEINT)", f"CAST(({d}) * 100 AS HUGEINT)"
    return (f"CASE WHEN ({d}) = 0 OR ({d}) IS NULL OR ({n}) IS NULL THEN NULL ELSE "
            f"CAST(SIGN({nc}) * SIGN({dc}) * ((200 * ABS({nc}) + ABS({dc})) // (2 * ABS({dc}))) AS DOUBLE) / 100.0 END")


view("summary", ["inside_t", "outside_t"], f"""
SELECT k.candidate_id, k.cycle,
  COALESCE(i.inside_receipts, 0) AS inside_receipts,
  COALESCE(i.inside_disbursements, 0) AS inside_disbursements,
  COALESCE(o.outside_support, 0) AS outside_support,
  COALESCE(o.outside_oppose, 0) AS outside_oppose,
  {ratio_sql('COALESCE(o.outside_support, 0) + COALESCE(o.outside_oppose, 0)', 'COALESCE(i.inside_disbursements, 0)')} AS influence_ratio,
  {ratio_sql('COALESCE(o.outside_oppose, 0)', 'COALESCE(i.inside_disbursements, 0)')} AS vulnerability_factor
FROM (SELECT candidate_id, cycle FROM inside_t UNION SELECT candidate_id, cycle FROM outside_t) k
LEFT JOIN (SELECT candidate_id, cycle, SUM(receipts) AS inside_receipts, SUM(disbursements) AS inside_disbursements
           FROM inside_t GROUP BY candidate_id, cycle) i
  ON k.candidate_id = i.candidate_id AND k.cycle = i.cycle
LEFT JOIN (SELECT candidate_id, cycle,
             SUM(CASE WHEN support_oppose_indicator = 'S' THEN total ELSE 0 END) AS outside_support,
             SUM(CASE WHEN support_oppose_indicator = 'O' THEN total ELSE 0 END) AS outside_oppose
           FROM outside_t GROUP BY candidate_id, cycle) o
  ON k.candidate_id = o.candidate_id AND k.cycle = o.cycle
""")

view("election", ["summary"], f"""
SELECT cycle, CAST(COUNT(DISTINCT candidate_id) AS INTEGER) AS candidate_count,
  SUM(inside_receipts) AS total_inside_receipts,
  SUM(inside_disbursements) AS total_inside_disbursements,
  SUM(outside_support) AS total_outside_support,
  SUM(outside_oppose) AS total_outside_oppose,
  {ratio_sql('SUM(outside_support + outside_oppose)', 'SUM(inside_disbursements)')} AS global_influence_ratio
FROM summary GROUP BY cycle
""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *names: str) -> str:
    names_in_order = _order(names)
    if not names_in_order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in names_in_order)
    return f"WITH {ctes}\n{body}"


def cents_sql(v: str) -> str:
    return f"CAST(({v}) * 100 AS HUGEINT)"


def compact_sql(v: str) -> str:
    """Compact dollars for non-negative amounts, half up, in integer cents."""
    c = cents_sql(v)

    def tenths(unit_cents: int) -> str:
        return f"(({c} + {unit_cents // 20}) // {unit_cents // 10})"

    def whole(unit_cents: int) -> str:
        return f"(({c} + {unit_cents // 2}) // {unit_cents})"

    def one_dp(unit_cents: int) -> str:
        t = tenths(unit_cents)
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR)"

    return (f"CASE WHEN ({v}) IS NULL THEN NULL "
            f"WHEN ({v}) >= 1000000000 THEN '$' || {one_dp(100_000_000_000)} || 'B' "
            f"WHEN ({v}) >= 1000000 THEN '$' || {one_dp(100_000_000)} || 'M' "
            f"WHEN ({v}) >= 1000 THEN '$' || CAST({whole(100_000)} AS VARCHAR) || 'K' "
            f"ELSE '$' || CAST({whole(100)} AS VARCHAR) END")


def dollars_sql(v: str) -> str:
    """'$1,234,568' with half-away-from-zero whole dollars; 'N/A' for null."""
    r = f"CAST(ROUND(CAST(({v}) AS DECIMAL(38,2))) AS HUGEINT)"
    return (f"CASE WHEN ({v}) IS NULL THEN 'N/A' WHEN {r} < 0 THEN '-$' || format('{{:,}}', -{r}) "
            f"ELSE '$' || format('{{:,}}', {r}) END")


view("summary_c", ["summary", "candidates"], """
SELECT s.*, c.candidate_id AS c_id, c.name AS candidate_name, c.state AS candidate_state,
  c.office AS candidate_office, c.district AS candidate_district, c.party AS candidate_party,
  c.incumbent_challenge AS candidate_incumbent_challenge
FROM summary s LEFT JOIN candidates c ON s.candidate_id = c.candidate_id
""")

SUMMARY_OUT = ("candidate_id, cycle, CAST(inside_receipts AS DOUBLE) AS inside_receipts, "
               "CAST(inside_disbursements AS DOUBLE) AS inside_disbursements, "
               "CAST(outside_support AS DOUBLE) AS outside_support, "
               "CAST(outside_oppose AS DOUBLE) AS outside_oppose, influence_ratio, vulnerability_factor")
ELECTION_OUT = ("cycle, candidate_count, CAST(total_inside_receipts AS DOUBLE) AS total_inside_receipts, "
                "CAST(total_inside_disbursements AS DOUBLE) AS total_inside_disbursements, "
                "CAST(total_outside_support AS DOUBLE) AS total_outside_support, "
                "CAST(total_outside_oppose AS DOUBLE) AS total_outside_oppose, global_influence_ratio")
CANDIDATE_INFO_OUT = ("candidate_name, candidate_state, candidate_office, candidate_district, "
                      "candidate_party, candidate_incumbent_challenge")

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def title_sql(x: str) -> str:
    """Each letter run: first letter upper, rest lower."""
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


view("candidates_raw", [], """
SELECT CASE WHEN o.o_orderkey % 5 = 0 THEN ' ' || CAST(o.o_custkey AS VARCHAR) || ' '
            ELSE CAST(o.o_custkey AS VARCHAR) END AS candidate_id,
  CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN '   ' ELSE c.c_name END AS name,
  LOWER(CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'H' WHEN 'BUILDING' THEN 'S' WHEN 'AUTOMOBILE' THEN 'P' END) AS office,
  CAST(c.c_nationkey AS VARCHAR) AS state,
  CAST(o.o_custkey % 20 AS VARCHAR) AS district,
  SUBSTRING(o.o_orderpriority, 3, 10) AS party,
  CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS last_file_date,
  o.o_orderkey AS seq
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")

view("candidates_checked", ["candidates_raw"], f"""
SELECT seq, {strip_sql('candidate_id')} AS candidate_id,
  array_to_string(list_transform({words_sql(strip_sql('name'))}, lambda w: {title_sql('w')}), ' ') AS name,
  UPPER(office) AS office, {strip_sql('state')} AS state, {strip_sql('party')} AS party,
  CASE WHEN regexp_matches({strip_sql('district')}, '^[0-9]+$') AND length({strip_sql('district')}) < 2
       THEN lpad({strip_sql('district')}, 2, '0') ELSE {strip_sql('district')} END AS district,
  CAST(CAST(last_file_date AS DATE) AS VARCHAR) AS last_file_date,
  CASE WHEN {strip_sql('name')} = '' THEN 'name_required' ELSE '' END AS errors
FROM candidates_raw
""")

view("candidates_last", ["candidates_checked"], """
SELECT * EXCLUDE (last_rank) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY candidate_id ORDER BY seq DESC) AS last_rank
  FROM candidates_checked WHERE errors = '')
WHERE last_rank = 1
""")

view("committees_checked", [], f"""
SELECT s.s_suppkey AS seq, 'C' || lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') AS committee_id,
  UPPER(s.s_name) AS name,
  UPPER(CASE WHEN s.s_acctbal < 0 THEN 'z9'
             ELSE lower(substr('CDEHINOPQSUVWXYZ', CAST(s.s_suppkey % 16 AS INTEGER) + 1, 1)) END) AS committee_type,
  CASE WHEN s.s_suppkey % 3 IN (0, 1) THEN NULL ELSE {strip_sql('s.s_name')} END AS affiliated_committee_name,
  UPPER(substr(n.n_name, 1, CASE WHEN s.s_acctbal < 0 THEN 3 ELSE 2 END)) AS state,
  concat_ws(',', CASE WHEN s.s_acctbal < 0 THEN 'committee_type_domain' END,
                 CASE WHEN s.s_acctbal < 0 AND length(n.n_name) > 2 THEN 'state_length' END) AS errors
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
""")
