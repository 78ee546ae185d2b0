"""Queries of positioned words whose columns differ from file to file, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import sheets
from .registry import over

_FILE = "CAST(substring(file, 4) AS BIGINT)"


def _bands(w: DataFrame) -> DataFrame:
    """Bands of each file: they begin further right from file to file, with a gap before the last; every ninth file has none."""
    n = F.expr("CAST(substring(file, 4, 9) AS BIGINT)")
    shift = (n % 20).cast("double")
    rows = F.array(*[F.struct(F.lit(name).alias("nome"), (F.lit(lo) + shift).alias("lo"), (F.lit(hi) + shift).alias("hi")) for name, lo, hi in (("qtd", 285.0, 320.0), ("sku", 0.0, 100.0), ("descricao", 100.0, 280.0))])
    return w.select("file").distinct().filter(n % 9 != 0).select("file", F.inline(rows))


def _centres(w: DataFrame) -> DataFrame:
    """Header words of each file: three names, set apart further from file to file, the last of them twice."""
    n = F.expr("CAST(substring(file, 4, 9) AS BIGINT)")
    rows = F.array(*[F.struct(F.lit(0).cast("long").alias("page"), F.lit(-10.0 + i).alias("top"), (F.lit(280.0) + F.lit(k) * (F.lit(4.0) + n % 25)).alias("x0"), (F.lit(300.0) + F.lit(k) * (F.lit(4.0) + n % 25)).alias("x1"), F.lit(f"L{k}").alias("text")) for i, k in enumerate((0, 1, 2, 2))])
    return w.select("file").distinct().select("file", F.inline(rows))


over("j_16_bands_of_files", lambda w: sheets.assign_bands(w, _bands(w)).select("file", "page", "top", "x0", "text", "faixa"), "f8_words", f"""WITH b AS (SELECT file, unnest(['sku', 'descricao', 'qtd']) AS nome, unnest([0.0, 100.0, 285.0]) + {_FILE} % 20 AS lo, unnest([100.0, 280.0, 320.0]) + {_FILE} % 20 AS hi FROM (SELECT DISTINCT file FROM f8_words) WHERE {_FILE} % 9 <> 0)
SELECT w.file, page, top, x0, text, nome AS faixa FROM f8_words w LEFT JOIN b ON b.file = w.file AND x0 >= lo AND x0 < hi""")
over("j_17_centres_of_files", lambda w: sheets.assign_nearest(w, sheets.header_centres(_centres(w), "^L[0-9]+$")).select("file", "page", "top", "x0", "text", "alvo"), "f8_words", f"""WITH c AS (SELECT file, unnest(['L0', 'L1', 'L2']) AS nome, 290.0 + unnest([0, 1, 2]) * (4 + {_FILE} % 25) AS x FROM (SELECT DISTINCT file FROM f8_words)),
d AS (SELECT w.file, page, top, x0, text, nome, abs((x0 + x1) / 2 - x) AS d, row_number() OVER (PARTITION BY w.file, page, top, x0, text ORDER BY abs((x0 + x1) / 2 - x), x) AS o FROM f8_words w JOIN c ON c.file = w.file)
SELECT file, page, top, x0, text, CASE WHEN d <= 24 THEN nome END AS alvo FROM d WHERE o = 1""")
