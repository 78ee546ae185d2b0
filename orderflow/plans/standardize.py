"""From read order lines to queue rows (PIPE-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from ..operators import customers, dates, identity
from ..operators.identity import Layout


def judge_orders(items: DataFrame, layout: Layout | str, base: DataFrame, xref: DataFrame, today: str) -> DataFrame:
    """items standardised, with motivo_descarte: why a row stays out of the queue, or "".

    Customer, identity, conversion status, order number, ship date, release of trusted layouts and business rules in
    turn. A day that can't be read is null and so DATA_INVALIDA (D-01). Units are converted before, by convert_units.
    layout: one for all rows, or how the columns begin that have each row's, so that files of many layouts are one job.
    """
    known = identity.parameters(layout)
    # Customers first: they are found by what was read, and so the checks are made once and not again for each look-up.
    x = identity.check_identity(customers.resolve_customer(items, layout, base, xref), layout)
    order = S.text(F.col("numero_pedido_lido"))
    x = x.withColumns({
        "status_conversao": F.when(S.text(F.col("status_conversao")) == "", "").otherwise(identity.conversion_status(F.col("status_conversao"), F.col("status_conversao"))),
        "numero_pedido_final": F.when((order == "") & (known.file == "EXCEL"), ".").otherwise(order),
        "data_remessa_final": dates.ship_day(known.date_rule, F.col("data_entrega_lida"), F.lit(today).cast("date")),
    })
    return identity.validate_business(identity.release_trusted(x, layout), layout)


def standardize_orders(items: DataFrame, layout: Layout | str, base: DataFrame, xref: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Queue rows, and the rows that are left out with motivo_descarte; every row is in one of them (PIPE-01)."""
    x = judge_orders(items, layout, base, xref, today)
    return x.filter("motivo_descarte = ''"), x.filter("motivo_descarte <> ''")


def queue_rows(valid: DataFrame, *keep: str) -> DataFrame:
    """Standardised rows as the queue has them, and the columns keep."""
    quantity = X.first_nonblank(*[F.col(c) for c in ("qtd_final", "qtd_convertida", "quantidade_lida") if c in valid.columns])
    return valid.select("row_id", *keep, F.col("matricula_final").alias("matricula"), F.col("sku_lido").alias("sku"), quantity.alias("qtd"), F.col("numero_pedido_final").alias("pedido"), F.date_format("data_remessa_final", "dd.MM.yyyy").alias("data_remessa"))
