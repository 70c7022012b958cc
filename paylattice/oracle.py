"""Independent SQL for the registered queries, written for DuckDB over the same test tables."""

from __future__ import annotations

# Column lists are written out here, so that a column the operators lose is missed by the comparison.


def category_columns(side: str) -> list[str]:
    names = """okved_cd_{s} okato_cd_{s} bic_{s}_34 bic_{s}_56 bic_{s}_79 num_{s}_13 num_{s}_45 num_{s}_68
               okved_cd_{s}_lvl1 okved_cd_{s}_lvl2 okved_cd_{s}_lvl3 okved_cd_{s}_lvl4"""
    return names.format(s=side).split()


def indexed_columns(side: str) -> list[str]:
    return [f"inn_{side}", *category_columns(side)]


def index_features(side: str) -> list[str]:
    return [f"{c}_index" for c in indexed_columns(side)]


INTERACTION_KEYS = """
inn_dt inn_kt short_dt okved_cd_dt okato_cd_dt okved_cd_kt okato_cd_kt
bic_dt_34 bic_dt_56 bic_dt_79 num_dt_13 num_dt_45 num_dt_68
bic_kt_34 bic_kt_56 bic_kt_79 num_kt_13 num_kt_45 num_kt_68
""".split()
KT_WEIGHTS = """
inn_kt_weight okved_cd_kt_weight okato_cd_kt_weight bic_kt_34_weight bic_kt_56_weight bic_kt_79_weight
num_kt_13_weight num_kt_45_weight num_kt_68_weight okved_cd_kt_lvl1_weight okved_cd_kt_lvl2_weight
okved_cd_kt_lvl3_weight okved_cd_kt_lvl4_weight numbers_weight embedding_weight topic_weight
""".split()

# Named subqueries: name -> (subqueries it reads, text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    PARTS[name] = (needs, text)


def sql(select: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered) + "\n" + select


def other(side: str) -> str:
    return "kt" if side == "dt" else "dt"


# --- views ------------------------------------------------------------------------------

part("clients", """
SELECT unnest(CASE WHEN key % 4 = 0 THEN ['2024-09-30'] ELSE ['2024-09-30', '2024-06-30'] END) AS report_dt,
       inn, segment AS org_segment,
       CASE WHEN key % 10 = 9 THEN 'branch' WHEN key % 2 = 0 THEN 'company' ELSE 'trader' END AS type,
       CASE WHEN balance < -900 THEN 1 ELSE 0 END AS active_flg,
       CASE WHEN key % 6 > 0 THEN array_to_string(list_slice([n_regionkey::VARCHAR, n_nationkey::VARCHAR,
            (key % 7)::VARCHAR, (key % 3)::VARCHAR, (key % 2)::VARCHAR], 1, key % 6), '.') END AS okved_cd,
       n_name AS okato_cd
FROM (SELECT 'C' || c_custkey AS inn, c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance,
             c_mktsegment AS segment FROM customer
      UNION ALL
      SELECT 'S' || s_suppkey, s_suppkey, s_nationkey, s_acctbal,
             (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[s_suppkey % 5 + 1] FROM supplier) c
JOIN nation ON n_nationkey = nation
""")

part("base", """
SELECT inn, okved_cd, okato_cd FROM clients
WHERE report_dt = '2024-09-30' AND type IN ('company', 'trader') AND active_flg = 0
  AND org_segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
""", "clients")


def digits(width: int, *factors: tuple[str, int]) -> str:
    each = width // len(factors)
    return " || ".join(f"lpad((({key} + 1) * {prime} % {10**each})::VARCHAR, {each}, '0')" for key, prime in factors)


PAYMENT = """'C' || o_custkey AS inn_dt, 'S' || l_suppkey AS inn_kt, strftime(o_orderdate, '%Y-%m-%d') AS short_dt,
       round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(14,2) AS c_sum"""

part("payments", f"""
SELECT {PAYMENT},
       CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'contract' END AS predicted_value_last,
       {digits(9, ("o_custkey", 7919))} AS c_bic_dt,
       {digits(9, ("l_suppkey", 104729))} AS c_bic_kt,
       CASE WHEN l_orderkey % 11 <> 0 THEN
         {digits(20, ("o_custkey", 15485863), ("(l_orderkey % 3 + 1)", 32452843))} END AS c_num_dt,
       {digits(20, ("l_suppkey", 49979687), ("(l_orderkey % 2 + 1)", 67867967))} AS c_num_kt
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")

SUBSTRINGS = ", ".join(
    f"substr({source}_{s}, {start}, {length}) AS {name}"
    for s in ("dt", "kt")
    for source, start, length, name in (
        ("c_bic", 3, 2, f"bic_{s}_34"), ("c_bic", 5, 2, f"bic_{s}_56"), ("c_bic", 7, 2, f"bic_{s}_79"),
        ("c_num", 1, 3, f"num_{s}_13"), ("c_num", 4, 2, f"num_{s}_45"), ("c_num", 6, 3, f"num_{s}_68"),
    )
)

part("windowed", """
SELECT * FROM payments WHERE predicted_value_last = 'contract' AND short_dt BETWEEN '1995-01-01' AND '2001-12-31'
""", "payments")

KEYS = ", ".join(INTERACTION_KEYS)

part("all_interactions", f"""
SELECT {KEYS}, sum(c_sum) AS c_sum_fin
FROM (SELECT inn_dt, inn_kt, short_dt, c_sum, {SUBSTRINGS},
             k.okved_cd AS okved_cd_kt, k.okato_cd AS okato_cd_kt, d.okved_cd AS okved_cd_dt, d.okato_cd AS okato_cd_dt
      FROM windowed JOIN base k ON k.inn = inn_kt JOIN base d ON d.inn = inn_dt) GROUP BY {KEYS}
""", "windowed", "base")
part("train", "SELECT * FROM all_interactions WHERE short_dt <= '1998-12-31'", "all_interactions")
part("test", "SELECT * FROM all_interactions WHERE short_dt >= '1999-01-01'", "all_interactions")

LEVELS = {
    s: ", ".join(
        f"coalesce(nullif(split_part(okved_cd_{s}, '.', {i}), ''), '-1') AS okved_cd_{s}_lvl{i}" for i in range(1, 5)
    )
    for s in ("dt", "kt")
}
part("levelled", f"SELECT *, {LEVELS['dt']}, {LEVELS['kt']} FROM train", "train")
part("levelled_test", f"SELECT *, {LEVELS['dt']}, {LEVELS['kt']} FROM test", "test")

for s in ("dt", "kt"):
    own, partner = f"inn_{s}", f"inn_{other(s)}"
    for suffix, source in (("", "train"), ("_test", "test")):
        part(f"stats_{s}{suffix}", f"""
SELECT {own}, sum(c_sum_fin)::DOUBLE / count(*) AS {s}_avg_sum,
       coalesce(stddev_samp(x), 200000.0) AS {s}_stddev_sum,
       min(x) AS {s}_min_sum, max(x) AS {s}_max_sum, quantile_disc(x, 0.5) AS {s}_median_sum,
       CASE WHEN min(x) = max(x) THEN 2.5 ELSE avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 END AS {s}_skewness_sum,
       count(DISTINCT {partner}) AS {s}_buyers_count
FROM (SELECT {own}, {partner}, c_sum_fin, c_sum_fin::DOUBLE AS x, avg(c_sum_fin::DOUBLE) OVER (PARTITION BY {own}) AS m
      FROM {source}) GROUP BY {own}
""", source)
        earliest = ", ".join(f"substr(min(short_dt || {c}), 11) AS {c}" for c in category_columns(s))
        part(f"passport_{s}{suffix}", f"""
SELECT * FROM (SELECT {own}, {earliest} FROM levelled{suffix} GROUP BY {own}) JOIN stats_{s}{suffix} USING ({own})
""", f"levelled{suffix}", f"stats_{s}{suffix}")
    unpivoted = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS label FROM passport_{s}" for c in indexed_columns(s)
    )
    part(f"labels_{s}", f"""
SELECT "column", label, (row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, label) - 1)::INTEGER AS "index",
       count(*) AS frequency
FROM ({unpivoted}) WHERE label IS NOT NULL GROUP BY "column", label
""", f"passport_{s}")
    part(f"map_{s}", f"SELECT label AS {own}, \"index\" AS {own}_index FROM labels_{s} WHERE \"column\" = '{own}'", f"labels_{s}")
    numbers = ", ".join(
        f"{s}_{n}" for n in ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "skewness_sum", "buyers_count")
    )
    for suffix in ("", "_test"):
        joins = " ".join(
            f"LEFT JOIN labels_{s} l{i} ON l{i}.\"column\" = '{c}' AND l{i}.label = p.{c}"
            for i, c in enumerate(indexed_columns(s))
        )
        indices = ", ".join(
            f"coalesce(l{i}.\"index\", (SELECT count(*) FROM labels_{s} WHERE \"column\" = '{c}'))::INTEGER AS {c}_index"
            for i, c in enumerate(indexed_columns(s))
        )
        part(f"indexed_{s}{suffix}", f"SELECT p.{own}, {numbers}, {indices} FROM passport_{s}{suffix} p {joins}",
             f"passport_{s}{suffix}", f"labels_{s}")
        values = " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {f} AS value FROM indexed_{s}{suffix}" for f in index_features(s)
        )
        part(f"sizes_{s}{suffix}", f"""
SELECT feature, count(DISTINCT value) AS size, max(value) AS max_index FROM ({values}) GROUP BY feature
""", f"indexed_{s}{suffix}")

part("known_pairs", """
SELECT inn_dt_index, inn_kt_index, count(*) AS rows FROM test JOIN map_dt USING (inn_dt) JOIN map_kt USING (inn_kt)
GROUP BY ALL
""", "test", "map_dt", "map_kt")
part("train_pairs", """
SELECT inn_dt_index, inn_kt_index, count(*) AS n FROM train JOIN map_dt USING (inn_dt) JOIN map_kt USING (inn_kt)
GROUP BY ALL
""", "train", "map_dt", "map_kt")
for s in ("dt", "kt"):
    own, partner = f"inn_{s}_index", f"inn_{other(s)}_index"
    part(f"truth_{s}", f"""
SELECT {own}, {partner}, cnt::BIGINT AS cnt
FROM (SELECT *, sum(rows) OVER (PARTITION BY {own}) AS cnt FROM known_pairs) WHERE cnt >= 15
""", "known_pairs")
    part(f"history_{s}", f"""
SELECT {own} AS "user", {partner} AS item, row_number() OVER (PARTITION BY {own} ORDER BY n DESC, {partner}) AS rank
FROM train_pairs QUALIFY rank <= 100
""", "train_pairs")


def metrics(truth: str, predictions: str, ks: str) -> str:
    """Mean of the four metrics from `truth(user, item)` and `predictions(user, rank, item)` for duplicate-free lists."""
    return f"""
, sizes AS (SELECT "user", count(*) AS n FROM {truth} GROUP BY "user"),
hits AS (SELECT "user", rank, row_number() OVER (PARTITION BY "user" ORDER BY rank) AS found
         FROM {predictions} JOIN {truth} USING ("user", item)),
cuts AS (SELECT unnest({ks}) AS k),
users AS (SELECT "user", n, k FROM sizes CROSS JOIN cuts),
scored AS (SELECT u."user", k, any_value(n) AS n, coalesce(sum(found::DOUBLE / rank), 0) AS ap, count(rank) AS h,
                  coalesce(sum(1 / log2(rank + 1)), 0) AS dcg
           FROM users u LEFT JOIN hits h ON h."user" = u."user" AND h.rank <= u.k GROUP BY u."user", k),
each AS (SELECT k, ap / least(n, k) AS a, h::DOUBLE / n AS r, h::DOUBLE / k AS p,
                dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) AS g FROM scored),
means AS (SELECT k, {", ".join(f'sum({c}::DECIMAL(18,12))::DOUBLE / count(*) AS "{m}"' for c, m in zip("arpg", ("MAP", "Recall", "Precision", "NDCG")))}
          FROM each GROUP BY k)
SELECT metric, k::INTEGER AS k, round(value, 9) AS value
FROM (UNPIVOT means ON "MAP", "Recall", "Precision", "NDCG" INTO NAME metric VALUE value)"""


# --- words --------------------------------------------------------------------------------

part("payment_words", f"""
SELECT id, inn_dt, inn_kt, short_dt, c_sum, 0.5::DECIMAL(3,2) AS sum_koef,
       CASE WHEN line % 7 <> 0 THEN token END AS word, token AS word_v2
FROM (SELECT l_orderkey AS id, l_linenumber AS line, {PAYMENT}, unnest(string_split(p_name, ' ')) AS token
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
""")
part("word_rows", """
SELECT w.* FROM payment_words w JOIN base ON base.inn = w.inn_kt
WHERE short_dt >= '1999-01-01' AND inn_dt IS NOT NULL AND inn_kt IS NOT NULL AND inn_kt <> inn_dt
""", "payment_words", "base")
part("company_totals", """
SELECT inn_kt, count(DISTINCT id) AS all_nunique_cnt, sum(c_sum * sum_koef) AS all_sum FROM word_rows GROUP BY inn_kt
""", "word_rows")
part("word_totals", """
SELECT inn_kt, word, word_sum, word_nunique_cnt, all_nunique_cnt, all_sum
FROM (SELECT inn_kt, word, sum(c_sum * sum_koef) AS word_sum, count(DISTINCT id) AS word_nunique_cnt
      FROM word_rows WHERE word IS NOT NULL GROUP BY inn_kt, word) LEFT JOIN company_totals USING (inn_kt)
""", "word_rows", "company_totals")
part("word_scores", """
SELECT *, 0.7::DOUBLE * norm_sum + 0.3::DOUBLE * norm_freq AS total_score
FROM (SELECT *, coalesce(word_sum::DOUBLE / nullif(max(word_sum) OVER w, 0)::DOUBLE, 0) AS norm_sum,
             coalesce(word_nunique_cnt::DOUBLE / nullif(max(word_nunique_cnt) OVER w, 0), 0) AS norm_freq
      FROM word_totals WINDOW w AS (PARTITION BY inn_kt))
""", "word_totals")
part("word_map", """
SELECT word, (min(p_size) % 5)::DOUBLE AS map_weight, cat1, cat2
FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_size, p_type AS cat1, p_brand AS cat2 FROM part)
GROUP BY word, cat1, cat2
""")
part("categorised", """
SELECT inn_kt, word, word_sum, cat1, cat2, total_score FROM word_scores JOIN word_map USING (word)
WHERE map_weight < 3 AND cat1 IS NOT NULL AND cat2 IS NOT NULL AND word_sum IS NOT NULL
""", "word_scores", "word_map")
part("category_scores", """
SELECT inn_kt, cat1, cat2, sum(total_score::DECIMAL(20,12)) AS total_score, sum(word_sum) AS word_sum
FROM categorised GROUP BY inn_kt, cat1, cat2
""", "categorised")

# --- vectors -------------------------------------------------------------------------------

for s, letter in (("dt", "C"), ("kt", "S")):
    part(f"vectors_{s}", f"""
SELECT inn_{s}, inn_{s}_index, embedding FROM (SELECT '{letter}' || vec_id AS inn_{s}, embedding FROM embeddings)
JOIN map_{s} USING (inn_{s})
""", f"map_{s}")


def exact_topk(score: str) -> str:
    return f"""
SELECT "user", (row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item))::INTEGER AS rank, item, score
FROM (SELECT u.vec_id AS "user", i.vec_id AS item, round({score}(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
      FROM embeddings u JOIN embeddings i ON u.vec_id % 5 = 0 AND i.vec_id % 5 <> 0)
QUALIFY rank <= 100"""


# --- pairs -------------------------------------------------------------------------------------

ROW_KEYS = "inn_dt, inn_kt, short_dt, " + ", ".join(
    f"{b}_{s}_{p}" for s in ("kt", "dt") for b, ps in (("bic", ("34", "56", "79")), ("num", ("13", "45", "68"))) for p in ps
)
DRAW = f"('0x' || substr(md5(concat_ws('|', '42', {ROW_KEYS})), 1, 15))::BIGINT"

part("positives", f"""
SELECT *, {DRAW} AS h FROM train JOIN map_dt USING (inn_dt) JOIN map_kt USING (inn_kt)
""", "train", "map_dt", "map_kt")
for s in ("dt", "kt"):
    part(f"negatives_{s}", f"""
SELECT *, (r + CASE WHEN r >= inn_{s}_index THEN 1 ELSE 0 END)::INTEGER AS negative
FROM (SELECT *, h % ((SELECT count(*) FROM map_{s}) - 1) AS r FROM positives)
""", "positives", f"map_{s}")
    own = f"inn_{other(s)}"
    part(f"pairs_{s}", f"""
SELECT 1 AS label, {own}, {own}_index, inn_{s}, inn_{s}_index, short_dt FROM negatives_{s}
UNION ALL
SELECT 0, n.{own}, n.{own}_index, m.inn_{s}, m.inn_{s}_index, n.short_dt
FROM negatives_{s} n JOIN map_{s} m ON m.inn_{s}_index = n.negative
""", f"negatives_{s}", f"map_{s}")

part("popular", """
SELECT inn_kt_index AS negative, weight, (sum(weight) OVER (ORDER BY inn_kt_index) - weight)::BIGINT AS start
FROM (SELECT inn_kt_index, count(*) AS weight FROM positives GROUP BY inn_kt_index)
""", "positives")

part("scores", """
SELECT doc_id, quality::DOUBLE AS label, (n_chars % 97 - 48) / 16.0::DOUBLE + quality * 0.75::DOUBLE AS logit
FROM labels JOIN documents USING (doc_id)
""")

LOSS = "greatest(logit, 0) + ln(1 + exp(-abs(logit))) - logit * label"

part("requests", """
SELECT CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE 'C' END || c_custkey AS inn_dt, c_name AS client_name
FROM customer
""")
part("known_recommendations", """
SELECT inn_dt, inn_kt, rank::INTEGER AS rank
FROM history_dt h JOIN map_dt d ON d.inn_dt_index = h."user" JOIN map_kt k ON k.inn_kt_index = h.item
""", "history_dt", "map_dt", "map_kt")
part("recommendations", """
SELECT * FROM known_recommendations
UNION ALL
SELECT inn_dt, inn_kt, shared_rank FROM (SELECT DISTINCT inn_dt FROM requests WHERE inn_dt NOT IN (SELECT inn_dt FROM map_dt)),
  (SELECT inn_kt, (row_number() OVER (ORDER BY count(*) DESC, inn_kt))::INTEGER AS shared_rank
   FROM known_recommendations GROUP BY inn_kt QUALIFY shared_rank <= 100)
""", "known_recommendations", "requests", "map_dt")
part("requested", """
SELECT DISTINCT inn_dt, inn_kt, rank, client_name FROM recommendations JOIN requests USING (inn_dt)
""", "recommendations", "requests")

part("document_bags", r"""
SELECT doc_id, word_v2, count(*) AS n
FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n\t\r]+')) AS word_v2 FROM documents)
WHERE word_v2 <> '' GROUP BY doc_id, word_v2
""")


def numbers(side: str) -> str:
    return ", ".join(
        f"{side}_{n}" for n in ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "skewness_sum", "buyers_count")
    )


def _tower(width: int = 16, emb_width: int = 64) -> str:
    """Forward pass of a tower whose weights follow from their number, row and column, one layer per subquery."""
    names = index_features("kt")
    numbers = "avg_sum stddev_sum min_sum max_sum median_sum buyers_count".split()
    logged = [f"ln(1 + kt_{n}::DOUBLE)" for n in numbers]
    nums = ", ".join([*logged[:5], "kt_skewness_sum::DOUBLE", logged[5]])

    def w(n, row, col):
        return f"((({n}) * 7 + ({row}) * 5 + ({col}) * 3) % 13 - 6) / 20.0"

    def block(first: int, size: int) -> str:
        """Batch norm, linear layer, batch norm and ReLU of the list x."""
        normed = f"(x[k + 1] - {w(first, 0, 'k')}) / sqrt(1 + abs({w(first + 1, 0, 'k')}) + 1e-5)"
        linear = f"list_sum(list_transform(range({size}), lambda k: {normed} * ({w(first + 2, 'c', 'k')}))) + {w(first + 3, 0, 'c')}"
        out = f"({linear} - ({w(first + 4, 0, 'c')})) / sqrt(1 + abs({w(first + 5, 0, 'c')}) + 1e-5) * (1 + {w(first + 6, 0, 'c')}) + {w(first + 7, 0, 'c')}"
        return f"list_transform(range({width}), lambda c: greatest({out}, 0))"

    def times(n: int) -> str:
        return f"list_transform(range({width}), lambda c: list_sum(list_transform(range({width}), lambda j: x[j + 1] * ({w(n, 'c', 'j')}))))"

    slots = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""
, slots AS (SELECT slot, least(floor(sqrt(max_index + 1)), {width})::BIGINT AS dim FROM (VALUES {slots}) t(slot, feature) JOIN sizes_kt USING (feature)),
looked AS (SELECT inn_kt_index AS id, unnest(range({len(names)})) AS slot, unnest([{", ".join(names)}]) AS i FROM indexed_kt),
tokens AS (
  SELECT id, slot, list_transform(range({width}), lambda c:
    list_sum(list_transform(range(dim), lambda j: ({w('slot', 'i', 'j')}) * ({w('slot + 13', 'c', 'j')}))) + {w('slot + 26', 0, 'c')}) AS x
  FROM looked JOIN slots USING (slot)
  UNION ALL SELECT id, 13, {block(39, 7)} FROM (SELECT inn_kt_index AS id, [{nums}] AS x FROM indexed_kt)
  UNION ALL SELECT id, 14, {block(47, emb_width)} FROM (
    SELECT inn_kt_index AS id, coalesce(embedding::DOUBLE[], list_transform(range({emb_width}), lambda z: 0.0::DOUBLE)) AS x
    FROM indexed_kt LEFT JOIN (SELECT inn_kt_index, embedding FROM vectors_kt) USING (inn_kt_index))),
qkv AS (SELECT id, slot, {times(55)} AS q, {times(56)} AS k, {times(57)} AS v FROM tokens),
scores AS (SELECT a.id, a.slot, b.v, list_inner_product(a.q, b.k) / sqrt({width}) AS s FROM qkv a JOIN qkv b USING (id)),
attended AS (SELECT id, slot, v, exp(s - max(s) OVER (PARTITION BY id, slot)) AS e FROM scores),
z AS (SELECT id, slot, c, sum(e * v[c + 1]) / sum(e) AS z FROM attended, range({width}) t(c) GROUP BY ALL),
gates AS (SELECT id, slot, sum(z * ({w(58, 0, 'c')})) AS g FROM z GROUP BY ALL),
lifted AS (SELECT id, slot, exp(g - max(g) OVER (PARTITION BY id)) AS g FROM gates),
shares AS (SELECT id, slot, g / sum(g) OVER (PARTITION BY id) AS g FROM lifted),
pooled AS (SELECT id, c, sum(z * g) AS u FROM z JOIN shares USING (id, slot) GROUP BY ALL),
normed AS (
  SELECT id, c, (u - avg(u) OVER p) / sqrt(var_pop(u) OVER p + 1e-5) * (1 + {w(59, 0, 'c')}) + {w(60, 0, 'c')} AS e
  FROM pooled WINDOW p AS (PARTITION BY id))
SELECT id, 'embedding' AS part, c::INTEGER AS place, round(e, 4) + 0.0 AS value FROM normed
UNION ALL SELECT id, 'weights', slot::INTEGER, round(g, 4) + 0.0 FROM shares"""


def _pair_features(user_side: str) -> str:
    columns = ["label", "p.inn_dt_index", "p.inn_kt_index", "short_dt"]
    for role, s in (("user", user_side), ("item", other(user_side))):
        columns.append("concat_ws(',', " + ", ".join(f"{s}.{f}" for f in index_features(s)) + f") AS \"{role}\"")
        columns += [
            f"round({s}.{n.strip()}::FLOAT::DOUBLE, 3) AS double_{role}_{i}" for i, n in enumerate(numbers(s).split(","))
        ]
        columns += [f"64 AS {s}_width", f"round(coalesce(v{s}.embedding[8]::DOUBLE, 0), 6) AS {s}_emb_7"]
    return f"""SELECT {", ".join(columns)} FROM pairs_{other(user_side)} p
JOIN indexed_dt dt ON dt.inn_dt_index = p.inn_dt_index JOIN indexed_kt kt ON kt.inn_kt_index = p.inn_kt_index
LEFT JOIN vectors_dt vdt ON vdt.inn_dt_index = p.inn_dt_index
LEFT JOIN vectors_kt vkt ON vkt.inn_kt_index = p.inn_kt_index"""


def rounded_stats(s: str) -> str:
    return f"REPLACE (round({s}_stddev_sum, 4) AS {s}_stddev_sum, round({s}_skewness_sum, 6) AS {s}_skewness_sum)"


def _passport(s: str) -> str:
    return f"SELECT * {rounded_stats(s)} FROM (SELECT inn_{s}, {', '.join(category_columns(s))}, {numbers(s)} FROM passport_{s})"


LOGGED = ", ".join(
    f"round(ln(1 + kt_{n}), 6) AS kt_{n}" for n in ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "buyers_count")
)

part("pair_sums", """
SELECT inn_dt, inn_kt, sum(c_sum_fin)::DOUBLE AS x FROM train GROUP BY ALL HAVING x > 0
""", "train")
part("shares", "SELECT inn_dt, x / sum(x) OVER (PARTITION BY inn_dt) AS p FROM pair_sums", "pair_sums")


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["base_clients"] = sql("SELECT * FROM base", "base")
    q["first_clients"] = sql("SELECT inn FROM base ORDER BY inn LIMIT 500", "base")
    q["snapshot_inventory"] = sql(
        "SELECT report_dt, count(inn) AS clients, count(DISTINCT inn) AS distinct_clients FROM clients GROUP BY report_dt",
        "clients",
    )
    q["date_window"] = sql(
        "SELECT inn_dt, inn_kt, short_dt, c_sum::DOUBLE AS c_sum FROM payments "
        "WHERE short_dt BETWEEN '1999-01-01' AND '2001-12-31' AND predicted_value_last = 'contract'", "payments")
    q["bank_substrings"] = sql(
        f"SELECT inn_dt, inn_kt, short_dt, c_sum::DOUBLE AS c_sum, {SUBSTRINGS} FROM payments", "payments")
    q["interactions"] = sql("SELECT * REPLACE (c_sum_fin::DOUBLE AS c_sum_fin) FROM train", "train")
    for s in ("dt", "kt"):
        q[f"entity_stats_{s}"] = sql(f"SELECT * {rounded_stats(s)} FROM stats_{s}", f"stats_{s}")
        q[f"passport_{s}"] = sql(_passport(s), f"passport_{s}")
        q[f"label_index_{s}"] = sql(f"SELECT * FROM labels_{s}", f"labels_{s}")
    q["entity_stats_log"] = sql(
        f"SELECT inn_kt, {LOGGED}, round(kt_skewness_sum, 6) AS kt_skewness_sum FROM stats_kt", "stats_kt")
    q["code_levels"] = sql(
        "SELECT inn_dt, inn_kt, short_dt, "
        + ", ".join(f"okved_cd_{s}_lvl{i}" for s in ("dt", "kt") for i in range(1, 5)) + " FROM levelled", "levelled")
    q["entity_entropy"] = sql("""
SELECT inn_dt, count(*) AS partners, CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum(p * ln(p)), 6) END AS dt_entropy,
       CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum(p * ln(p)) / ln(count(*)), 6) END AS dt_normalized_entropy
FROM shares GROUP BY inn_dt""", "shares")
    q["partner_count_buckets"] = sql("""
, counts AS (SELECT inn_dt, count(DISTINCT inn_kt) AS c FROM train GROUP BY inn_dt),
bounds AS (SELECT list_distinct(quantile_disc(c, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS b FROM counts)
SELECT inn_dt, c AS dt_buyers_count, len(list_filter(b, lambda x: x <= c))::INTEGER AS dt_buyers_count_index
FROM counts, bounds""", "train")
    for key, s in (("passport_extended", "dt"), ("passport_extended_kt", "kt")):
        own, partner = f"inn_{s}", f"inn_{other(s)}"
        q[key] = sql(f"""
, amounts AS (SELECT {own}, {partner}, sum(c_sum_fin)::DOUBLE AS x FROM train GROUP BY ALL HAVING x > 0),
parts AS (SELECT {own}, x / sum(x) OVER (PARTITION BY {own}) AS p FROM amounts),
entropy AS (SELECT {own}, CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum(p * ln(p)), 6) END AS {s}_entropy,
                   CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum(p * ln(p)) / ln(count(*)), 6) END AS {s}_normalized_entropy
            FROM parts GROUP BY {own}),
counts AS (SELECT {own}, count(DISTINCT {partner}) AS c FROM train GROUP BY {own}),
bounds AS (SELECT list_distinct(quantile_disc(c, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS b FROM counts),
placed AS (SELECT {own}, len(list_filter(b, lambda x: x <= c))::INTEGER AS {s}_buyers_count_index FROM counts, bounds)
SELECT p.*, coalesce({s}_entropy, 0) AS {s}_entropy, coalesce({s}_normalized_entropy, 0) AS {s}_normalized_entropy,
       coalesce({s}_buyers_count_index, 0) AS {s}_buyers_count_index
FROM ({_passport(s)}) p LEFT JOIN entropy USING ({own}) LEFT JOIN placed USING ({own})""", "train", f"passport_{s}")
    q["asinh_weights"] = sql(
        "SELECT inn_dt, inn_kt, short_dt, c_sum_fin::DOUBLE AS c_sum_fin, round(asinh(c_sum_fin::DOUBLE), 9) AS weight FROM train",
        "train")
    q["label_map"] = sql(
        "SELECT 'dt' AS side, inn_dt AS inn, inn_dt_index AS \"index\" FROM map_dt "
        "UNION ALL SELECT 'kt', inn_kt, inn_kt_index FROM map_kt", "map_dt", "map_kt")
    q["passport_indexed"] = sql(f"SELECT * {rounded_stats('dt')} FROM indexed_dt", "indexed_dt")
    q["passport_indexed_kt"] = sql(f"SELECT * {rounded_stats('kt')} FROM indexed_kt", "indexed_kt")
    q["entity_feature_table"] = sql(f"SELECT * EXCLUDE (inn_kt) {rounded_stats('kt')} FROM indexed_kt", "indexed_kt")
    q["feature_sizes"] = sql(
        "SELECT *, 'dt' AS side FROM sizes_dt UNION ALL SELECT *, 'kt' FROM sizes_kt", "sizes_dt", "sizes_kt")
    q["feature_size_check"] = sql("""
SELECT 'dt_buyers_count_index' AS feature, 'missing' AS problem, NULL::INTEGER AS max_index, NULL::BIGINT AS size
UNION ALL SELECT feature, 'extra', NULL, size FROM sizes_dt WHERE feature = 'okved_cd_dt_lvl4_index'
UNION ALL SELECT feature, 'too small', t.max_index, s.size FROM sizes_dt s JOIN sizes_dt_test t USING (feature)
WHERE feature <> 'okved_cd_dt_lvl4_index' AND t.max_index >= s.size""", "sizes_dt", "sizes_dt_test")

    q["truth_sets"] = sql("SELECT * FROM truth_dt", "truth_dt")
    q["truth_sets_reverse"] = sql("SELECT * FROM truth_kt", "truth_kt")
    q["truth_set_size"] = sql("""
SELECT count(*) AS users, quantile_cont(n::DOUBLE, 0.5) AS median_size, round(sum(n) / count(*), 9) AS mean_size
FROM (SELECT count(*) AS n FROM truth_dt GROUP BY inn_dt_index)""", "truth_dt")
    q["top_active_users"] = sql("""
SELECT inn_dt_index AS "user", count(*) AS n_truth FROM truth_dt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", "truth_dt")
    for key, s in (("ranking_metrics", "dt"), ("ranking_metrics_reverse", "kt")):
        truth = f", truth AS (SELECT inn_{s}_index AS \"user\", inn_{other(s)}_index AS item FROM truth_{s})"
        q[key] = sql(truth + metrics("truth", f"history_{s}", "[10, 50, 100]"), f"truth_{s}", f"history_{s}")
    q["metrics_k_sweep"] = sql("""
, active AS (SELECT inn_dt_index AS "user" FROM truth_dt GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50),
truth AS (SELECT "user", inn_kt_index AS item FROM truth_dt JOIN active ON "user" = inn_dt_index)"""
        + metrics("truth", "history_dt", "range(2, 21)"), "truth_dt", "history_dt")

    q["word_rows"] = sql(
        "SELECT * REPLACE (c_sum::DOUBLE AS c_sum, sum_koef::DOUBLE AS sum_koef) FROM word_rows", "word_rows")
    q["company_totals"] = sql("SELECT * REPLACE (all_sum::DOUBLE AS all_sum) FROM company_totals", "company_totals")
    q["word_totals"] = sql("SELECT * REPLACE (word_sum::DOUBLE AS word_sum, all_sum::DOUBLE AS all_sum) FROM word_totals", "word_totals")
    q["word_scores"] = sql("""
SELECT * REPLACE (word_sum::DOUBLE AS word_sum, all_sum::DOUBLE AS all_sum, round(norm_sum, 9) AS norm_sum, round(norm_freq, 9) AS norm_freq, round(total_score, 9) AS total_score)
FROM word_scores""", "word_scores")
    q["top_words"] = sql("""
SELECT inn_kt, word, round(total_score, 9) AS total_score,
       (dense_rank() OVER (PARTITION BY inn_kt ORDER BY total_score DESC))::INTEGER AS word_rank
FROM (SELECT DISTINCT inn_kt, word, total_score FROM categorised) QUALIFY word_rank <= 5""", "categorised")
    rounded = "round(total_score::DOUBLE, 8) AS total_score, word_sum::DOUBLE AS word_sum"
    q["category_scores"] = sql(f"SELECT inn_kt, cat1, cat2, {rounded} FROM category_scores", "category_scores")
    q["category_ranks"] = sql(f"""
SELECT inn_kt, cat1, cat2, {rounded},
       (dense_rank() OVER (PARTITION BY inn_kt ORDER BY c.total_score DESC))::INTEGER AS total_rank
FROM category_scores c""", "category_scores")
    q["word_inventory"] = sql("""
SELECT 'companies' AS name, count(DISTINCT inn_kt) AS value FROM word_totals
UNION ALL SELECT 'map_words', count(DISTINCT word) FROM word_map
UNION ALL SELECT 'usable_map_words', count(DISTINCT word) FROM word_map WHERE map_weight < 3""", "word_totals", "word_map")
    q["source_csv_map"] = sql("SELECT * FROM word_map", "word_map")

    q["embedding_pack"] = sql("""
SELECT inn_dt, inn_dt_index, len(embedding)::INTEGER AS width, round(embedding[1]::DOUBLE, 6) AS e0,
       round(embedding[32]::DOUBLE, 6) AS e31, round(embedding[64]::DOUBLE, 6) AS e63,
       round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square_length FROM vectors_dt""", "vectors_dt")
    q["exact_topk_cosine"] = exact_topk("list_cosine_similarity")
    q["exact_topk_dot"] = exact_topk("list_inner_product")
    q["pair_scores"] = sql("""
SELECT inn_dt, inn_kt, round(list_inner_product(d.embedding::DOUBLE[], k.embedding::DOUBLE[]), 9) AS score
FROM (SELECT DISTINCT inn_dt, inn_kt FROM train) JOIN vectors_dt d USING (inn_dt) JOIN vectors_kt k USING (inn_kt)""",
        "train", "vectors_dt", "vectors_kt")
    q["entity_ids"] = sql("""
SELECT 'all' AS source, inn_dt_index AS id FROM indexed_dt
UNION ALL SELECT DISTINCT 'test_dict', inn_dt_index FROM truth_dt
UNION ALL SELECT 'list', inn_dt_index FROM requests JOIN map_dt USING (inn_dt)""", "indexed_dt", "truth_dt", "requests", "map_dt")

    q["tower_embeddings"] = sql(_tower(), "indexed_kt", "sizes_kt", "vectors_kt")
    q["shuffle_train"] = sql(f"SELECT {DRAW} AS shuffle_key, inn_dt, inn_kt, short_dt FROM train", "train")
    q["positive_pairs"] = sql("""
SELECT inn_dt, inn_kt, short_dt, inn_dt_index, inn_kt_index FROM test JOIN map_dt USING (inn_dt) JOIN map_kt USING (inn_kt)""",
        "test", "map_dt", "map_kt")
    q["pairs_forward"] = sql("SELECT * FROM pairs_kt", "pairs_kt")
    q["pairs_reverse"] = sql("SELECT * FROM pairs_dt", "pairs_dt")
    q["pairs_popularity"] = sql("""
, drawn AS (SELECT p.*, h % ((SELECT sum(weight) FROM popular)::BIGINT - w.weight) AS r, w.start AS s, w.weight AS w
            FROM positives p JOIN popular w ON w.negative = p.inn_kt_index),
moved AS (SELECT *, r + CASE WHEN r >= s THEN w ELSE 0 END AS place FROM drawn)
SELECT inn_dt_index, inn_kt_index, short_dt, p.negative FROM moved JOIN popular p
ON place >= p.start AND place < p.start + p.weight""", "positives", "popular")
    q["pairs_in_batch"] = sql("""
, placed AS (SELECT inn_dt_index, inn_kt_index, row_number() OVER (ORDER BY h) - 1 AS i FROM positives),
slots AS (SELECT *, i // 256 AS batch, i % 256 AS slot, count(*) OVER (PARTITION BY i // 256) AS n FROM placed)
SELECT a.batch, a.slot, shift::INTEGER AS shift, a.inn_dt_index, a.inn_kt_index, b.inn_kt_index AS negative
FROM slots a CROSS JOIN (SELECT unnest([1, 2]) AS shift) JOIN slots b ON b.batch = a.batch AND b.slot = (a.slot + shift) % a.n
WHERE a.inn_kt_index <> b.inn_kt_index""", "positives")
    q["in_batch_loss"] = sql("""
, placed AS (SELECT inn_dt_index, inn_kt_index, (row_number() OVER (ORDER BY h) - 1) // 256 AS batch FROM positives),
known AS (SELECT batch, p.inn_kt_index AS k, u.embedding::DOUBLE[] AS u, v.embedding::DOUBLE[] AS v
          FROM placed p JOIN vectors_dt u USING (inn_dt_index) JOIN vectors_kt v ON v.inn_kt_index = p.inn_kt_index)
SELECT a.batch, count(*) AS n,
       round(avg(ln(1 + exp(list_inner_product(a.u, b.v) - list_inner_product(a.u, a.v)))), 8) AS value
FROM known a JOIN known b ON a.batch = b.batch AND a.k <> b.k GROUP BY a.batch""", "positives", "vectors_dt", "vectors_kt")
    for key, s in (("pair_features", "dt"), ("pair_features_reverse", "kt")):
        q[key] = sql(_pair_features(s), f"pairs_{other(s)}", "indexed_dt", "indexed_kt", "vectors_dt", "vectors_kt")
    q["epoch_length"] = sql("""
SELECT 'train' AS part, count(*) * 2 AS samples, floor(count(*) * 2 / 4096)::BIGINT AS batches FROM train
UNION ALL SELECT 'val', count(*) * 2, ceil(count(*) * 2 / 4096)::BIGINT FROM test""", "train", "test")

    q["pointwise_metrics"] = sql("""
, levels AS (SELECT logit, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY logit),
cum AS (SELECT *, sum(neg) OVER (ORDER BY logit) - neg AS neg_below, sum(pos) OVER (ORDER BY logit DESC) AS tp,
               sum(pos + neg) OVER (ORDER BY logit DESC) AS shown FROM levels),
totals AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM scores)
SELECT 'accuracy' AS metric, round(avg(CASE WHEN (logit > 0) = (label = 1) THEN 1.0 ELSE 0 END), 9) AS value FROM scores
UNION ALL SELECT 'auc_roc', round(sum(pos * (neg_below + neg / 2)) / any_value(p * n), 9) FROM cum, totals
UNION ALL SELECT 'average_precision', round(sum(pos * tp / shown) / any_value(p), 9) FROM cum, totals
UNION ALL SELECT 'f1', round(2.0 * sum(CASE WHEN logit >= 0 THEN label ELSE 0 END)
                   / (sum(CASE WHEN logit >= 0 THEN 1 ELSE 0 END) + sum(label)), 9) FROM scores""", "scores")
    logit = "((inn_dt_index * 31 + {} * 17) % 101 - 50) / 25.0::DOUBLE"
    q["loss_report"] = sql(f"""
SELECT 'bce' AS loss, round(avg({LOSS}), 9) AS value FROM scores
UNION ALL SELECT 'bpr', round(avg(ln(1 + exp({logit.format("negative")} - {logit.format("inn_kt_index")}))), 9)
FROM negatives_kt""", "scores", "negatives_kt")
    q["metric_rollup"] = sql(f"""
, parts AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS part, doc_id // 64 AS batch FROM scores),
levels AS (SELECT part, batch, logit, sum(label) AS pos, sum(1 - label) AS neg FROM parts GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY part, batch ORDER BY logit) - neg AS neg_below,
               sum(pos) OVER (PARTITION BY part, batch ORDER BY logit DESC) AS caught,
               sum(pos + neg) OVER (PARTITION BY part, batch ORDER BY logit DESC) AS shown FROM levels),
sums AS (SELECT part, batch, sum(pos) AS p, sum(pos + neg) AS n, sum(pos * (neg_below + neg / 2)) AS ordered,
                sum(pos * caught / shown) AS ap, sum(CASE WHEN logit >= 0 THEN pos ELSE 0 END) AS tp,
                sum(CASE WHEN logit >= 0 THEN neg ELSE 0 END) AS fp FROM cum GROUP BY ALL)
SELECT part, 'accuracy' AS metric, round(avg(CASE WHEN (logit > 0) = (label = 1) THEN 1.0 ELSE 0 END), 9) AS average,
       count(*) AS n FROM parts GROUP BY part
UNION ALL SELECT part, 'bce', round(avg({LOSS}), 9), count(*) FROM parts GROUP BY part
UNION ALL SELECT part, 'auc_roc', round(sum(ordered / (p * (n - p)) * n) / sum(n), 9), sum(n)::BIGINT FROM sums
          WHERE p > 0 AND p < n GROUP BY part
UNION ALL SELECT part, 'average_precision', round(sum(ap / p * n) / sum(n), 9), sum(n)::BIGINT FROM sums WHERE p > 0 GROUP BY part
UNION ALL SELECT part, 'f1', round(sum(2 * tp / (tp + fp + p) * n) / sum(n), 9), sum(n)::BIGINT FROM sums
          WHERE tp + fp + p > 0 GROUP BY part""", "scores")

    q["cold_entities"] = sql("SELECT DISTINCT inn_dt FROM requests WHERE inn_dt NOT IN (SELECT inn_dt FROM map_dt)",
                             "requests", "map_dt")
    q["recommendation_table"] = sql("SELECT * FROM requested", "requested")
    q["recommendation_union"] = sql("""
SELECT inn_dt, client_name, NULL::VARCHAR AS inn_kt, NULL::INTEGER AS rank FROM requests
UNION ALL SELECT inn_dt, client_name, inn_kt, rank FROM requested""", "requests", "requested")
    named = ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS {n}" for i, n in enumerate(KT_WEIGHTS))
    q["importance_table"] = sql(f"SELECT inn_dt, inn_kt, rank, {named} FROM recommendations LEFT JOIN vectors_kt USING (inn_kt)",
                                "recommendations", "vectors_kt")

    q["entity_documents"] = sql("SELECT inn_kt, word_v2, count(*) AS n FROM payment_words GROUP BY ALL", "payment_words")
    q["word_counts"] = sql("""
, vocabulary AS (SELECT word_v2, sum(n) AS total FROM document_bags GROUP BY word_v2 HAVING count(*) >= 5
                 ORDER BY total DESC, word_v2 LIMIT 5000),
numbered AS (SELECT word_v2, (row_number() OVER (ORDER BY total DESC, word_v2) - 1)::INTEGER AS word_id FROM vocabulary)
SELECT doc_id, word_v2, word_id, n FROM document_bags JOIN numbered USING (word_v2)""", "document_bags")

    for key, s in (("offline_evaluation", "dt"), ("offline_evaluation_reverse", "kt")):
        user, item = f"u.inn_{s}_index", f"i.inn_{other(s)}_index"
        q[key] = sql(f"""
, truth AS (SELECT inn_{s}_index AS "user", inn_{other(s)}_index AS item FROM truth_{s}),
recs AS (SELECT {user} AS "user", {item} AS item,
                row_number() OVER (PARTITION BY {user} ORDER BY
                  round(list_cosine_similarity(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) DESC, {item}) AS rank
         FROM vectors_{s} u CROSS JOIN vectors_{other(s)} i
         WHERE {user} IN (SELECT "user" FROM truth) QUALIFY rank <= 100)"""
            + metrics("truth", "recs", "[10, 50, 100]"), f"truth_{s}", "vectors_dt", "vectors_kt")
    q["io_roundtrip"] = sql("""
SELECT substr(short_dt, 1, 7) AS "month", count(*) AS rows, sum(c_sum_fin)::DOUBLE AS total, 50 AS topics,
       (SELECT count(DISTINCT word_v2) FROM payment_words) AS words FROM train GROUP BY "month\"""",
        "train", "payment_words")
    return q
