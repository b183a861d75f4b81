"""Named SQL building blocks for the expected-result queries; ``with_parts`` puts together those that are needed."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, deps: str, sql: str) -> None:
    PARTS[name] = (tuple(deps.split()), sql)


def with_parts(names: str, body: str) -> str:
    """``WITH`` clause holding the named parts and what they build on, followed by ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body


def tokens(text: str, lower: bool = True) -> str:
    src = f"lower({text})" if lower else text
    return rf"list_filter(string_split_regex({src}, '\s+'), lambda x: x <> '')"


part("docs", "", f"SELECT CAST(doc_id AS VARCHAR) did, text, source, lang, {tokens('text')} toks FROM documents")
part("qs", "", f"SELECT CAST(item_id AS VARCHAR) qid, text query, {tokens('text')} toks FROM benchmark")
part("tf", "docs", "SELECT did, term, count(*) tf FROM (SELECT did, unnest(toks) term FROM docs) GROUP BY did, term")
part("qt", "qs", "SELECT qid, term, count(*) qtf FROM (SELECT qid, unnest(toks) term FROM qs) GROUP BY qid, term")
part("dfs", "tf", "SELECT term, count(*) df, CAST(sum(tf) AS BIGINT) cf FROM tf GROUP BY term")
part("dls", "docs", "SELECT did, len(toks) dl FROM docs")
part("tot", "docs", "SELECT count(*) n, avg(len(toks)) avgdl, CAST(sum(len(toks)) AS BIGINT) n_tokens FROM docs")


def topk(src: str, k: int, keys: str = "qid", extra: str = "") -> str:
    return (
        f"SELECT * FROM (SELECT *{extra}, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, did) rank "
        f"FROM {src}) WHERE rank <= {k}"
    )


def bm25(k1: float, b: float) -> str:
    return f"""SELECT qid, did, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * {k1 + 1.0}
        / (tf + {k1} * ({1.0 - b} + {b} * dl / avgdl))) score
        FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN dls USING (did), tot GROUP BY qid, did"""


part("all_a", "qt tf dfs dls tot", bm25(1.5, 0.75))
part("all_b", "qt tf dfs dls tot", bm25(0.9, 0.4))
part("run_a", "all_a", topk("all_a", 40, extra=", 'a' run_id"))
part("run_b", "all_b", topk("all_b", 40, extra=", 'b' run_id"))
part("overlap", "qt tf docs qs", """SELECT qid, did, count(*) h, any_value(n) n, any_value(m) m
    FROM qt JOIN tf USING (term) JOIN (SELECT qid, len(list_distinct(toks)) n FROM qs) USING (qid)
    JOIN (SELECT did, len(list_distinct(toks)) m FROM docs) USING (did) GROUP BY qid, did""")
part("all_c", "overlap", "SELECT qid, did, h / n score FROM overlap")
part("run_c", "all_c", topk("all_c", 40, extra=", 'c' run_id"))
part("runs", "run_a run_b run_c", """SELECT run_id, qid, did, rank, score FROM run_a UNION ALL
    SELECT run_id, qid, did, rank, score FROM run_b UNION ALL SELECT run_id, qid, did, rank, score FROM run_c""")
part("gold_counts", "run_b run_c overlap", """SELECT qid, did, h, n, m,
    CASE WHEN h * 20 >= n * 11 THEN 3 WHEN h * 20 >= n * 9 THEN 2 WHEN h * 20 >= n * 7 THEN 1 ELSE 0 END AS label
    FROM (SELECT qid, did FROM run_b WHERE rank <= 25 UNION SELECT qid, did FROM run_c WHERE rank <= 25)
    JOIN overlap USING (qid, did)""")
part("gold", "gold_counts", "SELECT qid, did, label FROM gold_counts")
part("pred", "run_a", """SELECT qid, did,
    CASE WHEN rank <= 2 THEN 3 WHEN rank <= 8 THEN 2 WHEN rank <= 18 THEN 1 ELSE 0 END AS label
    FROM run_a WHERE rank <= 30""")
part("raters", "gold_counts run_b", """SELECT qid, did, CAST(label >= 2 AS INT) r1, CAST(h * 40 >= n + m - h AS INT) r2,
    CAST(coalesce(rank, 999) <= 12 AS INT) r3
    FROM gold_counts LEFT JOIN (SELECT qid, did, rank FROM run_b) USING (qid, did)""")
part("vecs", "", "SELECT CAST(vec_id AS VARCHAR) id, CAST(embedding AS DOUBLE[]) v, label FROM embeddings")
part("all_cos", "vecs", """SELECT q.id qid, d.id did, list_dot_product(q.v, d.v)
    / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) score FROM vecs q JOIN vecs d ON q.id <> d.id""")
part("run_dense", "all_cos", topk("all_cos", 20, extra=", 'dense' run_id"))
