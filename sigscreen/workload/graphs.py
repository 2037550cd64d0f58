"""Iterative graph queries and centroid distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigscreen.operators import factors as X
from sigscreen.operators import iterate as T
from sigscreen.operators.folds import stratified_folds
from sigscreen.operators.vectors import oof_centroids
from sigscreen.runtime import cut_lineage
from sigscreen.workload import data as D
from sigscreen.workload.registry import Tables, md5_of, query, r6

ROUNDS = 4
STEPS = 3


def pagerank_sql(rounds: int) -> str:
    ctes = [D.EDGES, "arcs AS MATERIALIZED (SELECT src AS a, dst AS b, count(*)::double AS w "
            "FROM edges GROUP BY 1, 2)",
            "outs AS (SELECT a, sum(w) AS o FROM arcs GROUP BY 1)",
            "shares AS MATERIALIZED (SELECT a, b, w / o AS p FROM arcs JOIN outs USING (a))",
            "nodes AS MATERIALIZED (SELECT a AS id FROM arcs UNION SELECT b FROM arcs)",
            "cnt AS (SELECT count(*)::double AS n FROM nodes)",
            "k0 AS MATERIALIZED (SELECT id, 1.0 / n AS r FROM nodes, cnt)"]
    for i in range(1, rounds + 1):
        ctes.append(f"g{i} AS MATERIALIZED (SELECT id, coalesce(s, 0) AS s FROM nodes LEFT JOIN "
                    f"(SELECT b, sum(p * r) AS s FROM shares JOIN k{i - 1} ON a = id GROUP BY 1) "
                    "ON b = id)")
        ctes.append(f"k{i} AS MATERIALIZED (SELECT id, 0.15::double / n + 0.85::double * "
                    f"(1 - (SELECT sum(s) FROM g{i})) / n + 0.85::double * s AS r FROM g{i}, cnt)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, {r6('r', 'pagerank')} FROM k{rounds}"


@query("pagerank", pagerank_sql(ROUNDS))
def pagerank(t: Tables):
    return T.pagerank(D.edges(t), "src", "dst", ROUNDS)


def trade_edges(t: Tables):
    """Customers and suppliers, each tied to its nation: one component per nation in use."""
    return t.customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("src"),
        F.concat(F.lit("n"), "c_nationkey").alias("dst")).unionByName(t.supplier.select(
            F.concat(F.lit("s"), "s_suppkey").alias("src"),
            F.concat(F.lit("n"), "s_nationkey").alias("dst")))


@query("connected_components", """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a,
    'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey
    FROM supplier),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(id, other) AS (SELECT a, a FROM u UNION SELECT reach.id, u.b FROM reach
    JOIN u ON reach.other = u.a)
  SELECT id, min(other) AS component FROM reach GROUP BY 1""")
def connected_components(t: Tables):
    return T.connected_components(trade_edges(t), "src", "dst")


def propagation_sql(rounds: int) -> str:
    ctes = [D.PAIRS, D.FOLDS, "runs AS (SELECT DISTINCT fold AS run FROM folds)",
            "seeds AS MATERIALIZED (SELECT run, id, label AS lab FROM folds, runs "
            "WHERE label IS NOT NULL AND run <> fold)",
            "s0 AS (SELECT * FROM seeds)"]
    for i in range(1, rounds + 1):
        ctes.append(f"v{i} AS (SELECT run, a AS id, lab, sum(out_n + in_n) AS n FROM pairs "
                    f"JOIN s{i - 1} s ON b = s.id GROUP BY 1, 2, 3)")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT run, id, coalesce(seeds.lab, w.lab) AS lab FROM "
                    f"(SELECT run, id, lab FROM (SELECT *, row_number() OVER (PARTITION BY run, id "
                    f"ORDER BY n DESC, lab) AS rk FROM v{i}) WHERE rk = 1) w "
                    "FULL JOIN seeds USING (run, id))")
    return ("WITH " + ", ".join(ctes) + f" SELECT f.id, s.lab AS lp_label FROM s{rounds} s "
            "JOIN folds f ON f.id = s.id AND f.fold = s.run")


@query("label_propagation", propagation_sql(3))
def label_propagation(t: Tables):
    return T.label_propagation(D.pairs(t), D.folds(t), "id", "label", 3)


def walks_sql(steps: int, per_node: int) -> str:
    ctes = [D.PAIRS,
            f"adj AS MATERIALIZED (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY "
            f"{md5_of('a', 'b')}, a, b) AS pos, count(*) OVER (PARTITION BY a) AS deg FROM pairs)",
            f"w0 AS (SELECT DISTINCT a AS id, k AS walk, a AS place, a::varchar AS path, deg "
            f"FROM adj, generate_series(1, {per_node}) s(k))"]
    for i in range(1, steps + 1):
        draw = f"('0x' || substr({md5_of('w.id', 'w.walk', str(i))}, 1, 12))::bigint"
        ctes.append(
            f"w{i} AS MATERIALIZED (SELECT w.id, w.walk, adj.b AS place, w.path || '>' || adj.b AS "
            f"path, d.deg FROM w{i - 1} w JOIN adj ON adj.a = w.place AND adj.pos = {draw} % w.deg "
            "+ 1 JOIN (SELECT DISTINCT a, deg FROM adj) d ON d.a = adj.b)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, walk, path FROM w{steps}"


@query("random_walks", walks_sql(STEPS, 2))
def random_walks(t: Tables):
    return T.random_walks(D.kept_pairs(t), STEPS, 2).withColumn(
        "path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@query("projected_embeddings")
def projected(t: Tables):
    return T.projected_embeddings(T.random_walks(D.kept_pairs(t), STEPS, 2), 8).select(
        "id", F.array_join(F.transform("embedding", lambda v: F.round(v, 4).cast("string")), ",")
        .alias("embedding"))


def embeddings_sql(dim: int, window: int) -> str:
    """One row per (id, dim): the mean sign of the nodes near a node on its walks."""
    sign = f"CASE WHEN substr({md5_of('other', seed='0.X')}, 1, 1) < '8' THEN 1 ELSE -1 END".replace(
        "'0.X'", "'0.' || dim")
    return f"""WITH walks AS ({walks_sql(STEPS, 2)}),
      steps AS (SELECT id AS start, walk, unnest(string_split(path, '>')) AS node,
        generate_subscripts(string_split(path, '>'), 1) AS i FROM walks),
      near AS (SELECT a.node AS id, b.node AS other, count(*) AS n FROM steps a JOIN steps b
        ON a.start = b.start AND a.walk = b.walk AND abs(a.i - b.i) <= {window}
        WHERE a.node <> b.node GROUP BY 1, 2)
      SELECT id, dim::integer AS dim, {r6(f'sum(n * ({sign}))::double / sum(n)', 'value')}
      FROM near, range({dim}) d(dim) GROUP BY id, dim"""


@query("walk_embeddings", embeddings_sql(8, 2))
def embedded(t: Tables):
    walks = T.random_walks(D.kept_pairs(t), STEPS, 2)
    return T.walk_embeddings(walks, 8).select("id", F.posexplode("embedding").alias("dim", "value"))


@query("oof_centroids", f"""WITH f AS (SELECT vec_id, label, embedding, (row_number() OVER
    (PARTITION BY label ORDER BY {md5_of('vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings),
  cells AS (SELECT vec_id, label, fold, unnest(embedding)::double AS x,
    generate_subscripts(embedding, 1) AS dim FROM f),
  runs AS (SELECT DISTINCT fold AS run FROM f),
  centers AS (SELECT run, label, dim, avg(x) AS m FROM cells, runs WHERE fold <> run
    GROUP BY 1, 2, 3)
  SELECT vec_id, c.label::bigint AS label, {r6('sqrt(sum((x - m) * (x - m)))', 'distance')}
  FROM cells JOIN centers c ON cells.fold = c.run AND cells.dim = c.dim GROUP BY 1, 2""")
def centroids(t: Tables):
    folds = stratified_folds(t.embeddings, "vec_id", "label").select("vec_id", "fold")
    return oof_centroids(t.embeddings.join(folds, "vec_id"), "vec_id", "embedding", "label")


WINDOW, SHIFT = 2, 1.5


def pmi_sql() -> str:
    return f"""walks AS ({walks_sql(STEPS, 2)}),
      steps AS (SELECT id AS start, walk, unnest(string_split(path, '>')) AS node,
        generate_subscripts(string_split(path, '>'), 1) AS at FROM walks),
      near AS (SELECT a.node AS i, b.node AS j, count(*) AS n FROM steps a JOIN steps b
        ON a.start = b.start AND a.walk = b.walk AND abs(a.at - b.at) <= {WINDOW} WHERE a.node <> b.node GROUP BY 1, 2),
      s AS (SELECT i, sum(n)::double AS s FROM near GROUP BY 1),
      pmi AS (SELECT i, j, v FROM (SELECT near.i, near.j, ln(n::double * (SELECT sum(n) FROM near)::double / (a.s * b.s)) - ln({SHIFT}::double) AS v
        FROM near JOIN s a ON a.i = near.i JOIN s b ON b.i = near.j) WHERE v > 0)"""


def walk_matrix(t: Tables):
    return X.shifted_pmi(X.cooccurrences(T.random_walks(D.kept_pairs(t), STEPS, 2), WINDOW), SHIFT)


@query("walk_pmi", f"WITH {pmi_sql()} SELECT i, j, {r6('v', 'v')} FROM pmi")
def walk_pmi(t: Tables):
    return walk_matrix(t)


@query("walk_factors", f"""WITH {pmi_sql()} SELECT {r6('sum(v * v)', 'norm')}, true AS upright, true AS exact, true AS gains FROM pmi""")
def walk_factors(t: Tables):
    """The factors of the walks' matrix: unit vectors at right angles, whose error is what their eigenvalues do not hold."""
    entries = cut_lineage(walk_matrix(t))
    found, values = X.factorise(entries, 8)
    facts = X.rebuilt(entries, cut_lineage(found), values)
    return facts.select("norm", (F.col("apart") < 1e-6).alias("upright"),
                        (F.abs(F.col("error") - (F.col("norm") - F.col("held"))) < 1e-6 * F.col("norm")).alias("exact"),
                        (F.col("error") < F.col("norm")).alias("gains"))


# Eigenvectors are SQL's to check only by what they rebuild, as above; the tests compare them with a dense decomposition.
@query("learned_embeddings")
def learned(t: Tables):
    found = X.learned_embeddings(T.random_walks(D.kept_pairs(t), STEPS, 2), 8, WINDOW, SHIFT)
    return found.select("id", F.posexplode("embedding").alias("dim", "value"))
