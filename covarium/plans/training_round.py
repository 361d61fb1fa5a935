"""One whole round of training as a query, and the same round stated in SQL: draws, initial values, windows, the step over the tree, clipping, averages over tasks, decay and loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.operators import training
from covarium.plans.catalogue import _SQL_UNIT, H_SQL, _sql_draws, _sql_mix, part_lines, query

#: Three tasks, each with all of its lines in one batch, in double numbers; the clip is small enough to act.
ROUND = training.Config(d_word=4, d_patient=2, d_encounter=2, d_out=4, epoch=1, min_n=3, max_n=4, subsample=0.01, grad_clip=0.02, weight_decay=0.1, ngram_buckets=300, chunk_size=10**9, batch=10**9, tasks=3, precision="double")


def _sql_initial(name: str, row: str, col: str) -> str:
    """The trainer's Gaussian value of a cell."""
    k = [f"{x}::UHUGEINT" for x in training.MULT]
    first = (ROUND.seed << 20) + training.INIT + training.NAMES.index(name)
    use = lambda u: _SQL_UNIT.format(_sql_mix(f"{first}::UHUGEINT * {k[0]} + {row}::UHUGEINT * {k[1]} + {col}::UHUGEINT * {k[2]} + {u}::UHUGEINT * {k[3]}"))
    scale = ROUND.d_out if name == "W_proj" else ROUND.columns[name]
    return f"sqrt(-2 * ln(1 - {use(0)})) * cos(2 * pi() * {use(1)}) / sqrt({scale}::DOUBLE)"


def _sql_matrix(name: str, rows: str) -> str:
    """(row, vec) before training; `rows` selects the row numbers as `r`."""
    return f"SELECT r, list(x ORDER BY j) AS vec FROM (SELECT r, j, {_sql_initial(name, 'r', 'j')} AS x FROM ({rows}), (SELECT unnest(range({ROUND.columns[name]})) AS j)) GROUP BY r"


_DOT = "list_inner_product({}, {})"
_SUM = "(SELECT {keys}, list(x ORDER BY j) AS v FROM (SELECT {keys}, j, sum(x) AS x FROM (SELECT {keys}, unnest({vec}) AS x, unnest(range({n})) AS j FROM {table}) GROUP BY ALL) GROUP BY ALL)"
_LR, _CLIP, _MID = ROUND.lr, ROUND.grad_clip, ROUND.d_word + ROUND.d_patient


def _sum(table: str, keys: str, vec: str, n: int) -> str:
    """Element-wise sums by key, as `v`."""
    return _SUM.format(table=table, keys=keys, vec=vec, n=n)


def _moved(name: str, table: str, dense: bool, extra: str = "") -> str:
    """Rows after the round: `table` has (task, r, v)."""
    n = ROUND.columns[name]
    mean = f"x / {ROUND.tasks}" if dense else "x / tasks"
    return f"""SELECT '{name}' AS part, m.r AS row, list_sum(list_transform(range(1, {n + 1}), lambda j: j * (m.vec[j] + coalesce(e.v[j], 0.0)){extra})) AS checked FROM m_{name} m LEFT JOIN (
  SELECT r, list({mean} ORDER BY j) AS v FROM (SELECT r, j, sum(x) AS x, count(*) AS tasks FROM (SELECT r, unnest(v) AS x, unnest(range({n})) AS j FROM {table}) GROUP BY r, j) GROUP BY r) e ON e.r = m.r"""


SQL = f"""WITH RECURSIVE
s AS MATERIALIZED (SELECT p_partkey AS sample, ('0x' || substr(md5('slot-{ROUND.seed}-' || p_partkey), 1, 8))::BIGINT % {ROUND.tasks} AS task, lower(p_brand) AS pat, 'size:' || p_size AS enc,
  list_filter(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' '), lambda x: x <> '') AS words FROM part),
c AS (SELECT token, count(*) AS freq FROM (SELECT unnest(words) AS token FROM s) GROUP BY token), {H_SQL},
k AS MATERIALIZED (SELECT idx, token, path, code, greatest(0.0::DOUBLE, 1 - sqrt({ROUND.subsample}::DOUBLE * (SELECT sum(freq)::DOUBLE FROM v) / freq)) AS skip FROM v JOIN d ON node = idx),
pv AS (SELECT pat, row_number() OVER (ORDER BY count(*) DESC, pat) - 1 AS r FROM s GROUP BY pat),
ev AS (SELECT enc, row_number() OVER (ORDER BY count(*) DESC, enc) - 1 AS r FROM s GROUP BY enc),
g AS MATERIALIZED (SELECT idx, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(gram, ''), lambda x: ord(x)::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % {ROUND.ngram_buckets})::BIGINT AS r
  FROM (SELECT idx, substr('<' || token || '>', i + 1, n) AS gram FROM (SELECT idx, token, n, unnest(range(length(token) + 3 - n)) AS i FROM k, (SELECT unnest([3, 4]) AS n) WHERE length(token) + 2 >= n))),
m_output AS MATERIALIZED ({_sql_matrix('output', 'SELECT unnest(range(n - 1)) AS r FROM f')}),
m_input AS MATERIALIZED ({_sql_matrix('input', 'SELECT idx AS r FROM k')}),
m_ngram AS MATERIALIZED ({_sql_matrix('ngram', 'SELECT DISTINCT r FROM g')}),
m_W_proj AS MATERIALIZED ({_sql_matrix('W_proj', f'SELECT unnest(range({ROUND.d_out})) AS r')}),
m_patient AS MATERIALIZED ({_sql_matrix('patient', 'SELECT r FROM pv')}),
m_encounter AS MATERIALIZED ({_sql_matrix('encounter', 'SELECT r FROM ev')}),
W AS (SELECT list(vec ORDER BY r) AS w FROM m_W_proj),
wv AS MATERIALIZED (SELECT idx, v FROM {_sum("(SELECT r AS idx, vec FROM m_input UNION ALL SELECT idx, vec FROM g JOIN m_ngram USING (r))", 'idx', 'vec', ROUND.d_word)}),
p AS MATERIALIZED (SELECT 0 AS epoch, sample, task, pos, idx, skip FROM (SELECT sample, task, unnest(words) AS token, unnest(range(len(words))) AS pos FROM s) JOIN k USING (token)),
ce AS MATERIALIZED (SELECT *, 1 + ({_sql_draws('1')} % {ROUND.window_size})::BIGINT AS win FROM p WHERE {_SQL_UNIT.format(_sql_draws('0'))} >= skip),
cx AS MATERIALIZED (SELECT sample, pos, task, idx, ctx FROM (SELECT ce.epoch, ce.sample, ce.pos, ce.task, ce.idx, o.pos AS other, o.idx AS ctx, o.skip FROM ce JOIN p o ON o.sample = ce.sample AND o.pos <> ce.pos AND abs(o.pos - ce.pos) <= win)
  WHERE {_SQL_UNIT.format(_sql_draws('2 + other'))} >= skip),
z AS MATERIALIZED (SELECT DISTINCT sample, pos, task, idx, pr, er, list_concat(wv.v, pm.vec, em.vec) AS z FROM (SELECT DISTINCT sample, pos, task, idx FROM cx) JOIN wv USING (idx)
  JOIN (SELECT sample, pv.r AS pr, ev.r AS er FROM s JOIN pv USING (pat) JOIN ev USING (enc)) USING (sample) JOIN m_patient pm ON pm.r = pr JOIN m_encounter em ON em.r = er),
h AS MATERIALIZED (SELECT *, sqrt(list_inner_product(h, h)) AS size FROM (SELECT *, list_transform(w, lambda x: list_inner_product(x, z)) AS h FROM z, W)),
u AS MATERIALIZED (SELECT *, {_LR}::DOUBLE * (target - s) AS step FROM (
  SELECT sample, pos, task, r, target, h, size, o.vec AS o, 1 / (1 + exp(-greatest(-20.0, least(20.0, list_inner_product(o.vec, h))))) AS s
  FROM (SELECT sample, pos, unnest(path) AS r, 1 - unnest(code) AS target FROM cx JOIN k ON k.idx = ctx) JOIN h USING (sample, pos) JOIN m_output o USING (r))),
mo AS MATERIALIZED (SELECT task, r, list_transform(v, lambda x: x / (1 + short)) AS v FROM
  {_sum('u', 'task, r', f'list_transform(h, lambda x: x * step * least(1.0, {_CLIP}::DOUBLE / greatest(abs(step) * size, 1e-30)))', ROUND.d_out)}
  JOIN (SELECT task, r, {_LR}::DOUBLE * sum(s * (1 - s) * size * size) AS short FROM u GROUP BY task, r) USING (task, r)),
gr AS MATERIALIZED (SELECT sample, pos, task, idx, pr, er, z, list_transform(v, lambda x: x * least(1.0, {_CLIP}::DOUBLE / greatest(sqrt(list_inner_product(v, v)), 1e-30))) AS grad FROM
  {_sum('u', 'sample, pos', 'list_transform(o, lambda x: x * step)', ROUND.d_out)} JOIN h USING (sample, pos)),
q AS MATERIALIZED (SELECT task, idx, pr, er, list_transform(range(1, {ROUND.columns['W_proj'] + 1}), lambda j: {_LR}::DOUBLE * list_inner_product(grad, list_transform(w, lambda x: x[j]))) AS q FROM gr, W),
mi AS MATERIALIZED {_sum('q', 'task, idx', f'q[1:{ROUND.d_word}]', ROUND.d_word)},
mg AS (SELECT * FROM {_sum('(SELECT task, r, v FROM mi JOIN g USING (idx))', 'task, r', 'v', ROUND.d_word)}),
mp AS (SELECT task, pr AS r, v FROM {_sum('q', 'task, pr', f'q[{ROUND.d_word + 1}:{_MID}]', ROUND.d_patient)}),
me AS (SELECT task, er AS r, v FROM {_sum('q', 'task, er', f'q[{_MID + 1}:{ROUND.columns["W_proj"]}]', ROUND.d_encounter)}),
mw AS (SELECT task, r, v FROM {_sum(f"(SELECT task, unnest(range({ROUND.d_out})) AS r, unnest(list_transform(grad, lambda x: list_transform(z, lambda y: {_LR}::DOUBLE * x * y))) AS v FROM gr)", 'task, r', 'v', ROUND.columns['W_proj'])}),
rows AS ({_moved('output', 'mo', False)} UNION ALL {_moved('input', '(SELECT task, idx AS r, v FROM mi)', False)} UNION ALL {_moved('ngram', 'mg', False)}
  UNION ALL {_moved('W_proj', 'mw', True, f' * {1 - ROUND.weight_decay}::DOUBLE')} UNION ALL {_moved('patient', 'mp', True)} UNION ALL {_moved('encounter', 'me', True)})
SELECT part, row::BIGINT AS row, round(checked, 6) + 0.0 AS checked FROM rows
UNION ALL SELECT 'loss', 0, round(-sum(target * ln(greatest(1e-7, least(1 - 1e-7, s))) + (1 - target) * ln(1 - greatest(1e-7, least(1 - 1e-7, s)))) / count(*), 6) FROM u
UNION ALL SELECT 'predictions', 0, count(*)::DOUBLE FROM u UNION ALL SELECT 'lr', 0, {_LR}::DOUBLE"""


@query(SQL)
def train_round(spark: SparkSession, d: str) -> DataFrame:
    """A round over the part names: a check sum of every row of every matrix after it, the mean loss, the predictions and the step size."""
    got = training.train(part_lines(spark, d), ROUND, key="p_partkey")
    names = F.array(*[F.lit(k) for k in training.NAMES])
    own = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    rows = got.params.select(F.element_at(names, F.col("matrix") + 1).alias("part"), "row", (F.round(own, 6) + 0.0).alias("checked"))
    _, loss, preds, _, lr = got.metrics[0]
    return rows.unionByName(spark.createDataFrame([("loss", 0, round(loss, 6)), ("predictions", 0, float(preds)), ("lr", 0, lr)], "part string, row long, checked double"))
