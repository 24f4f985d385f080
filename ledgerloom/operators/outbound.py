"""Shipment and settlement tables of a platform: raw columns to the standard ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_amount_platform
from ..sources.files import standard_name
from .cleaning import rename_columns

# Standard columns, the numeric ones, and source names with the standard name of each.
SETTLEMENT_COLUMNS = (
    "partner_txn_id", "original_txn_id", "amount", "rmb_amount", "fee", "settlement", "rmb_settlement", "currency", "rate",
    "payment_time", "settlement_time", "type", "status", "stem_from", "remarks", "month", "source_file",
)
SETTLEMENT_NUMBERS = ("amount", "rmb_amount", "fee", "settlement", "rmb_settlement", "rate")
SETTLEMENT_NAMES = {"partner_transaction_id": "partner_txn_id", "original_partner_transaction_id": "original_txn_id"}
BATCH_COLUMNS = ("settle_batch_no", "settle_date", "amount", "fee", "settlement", "currency", "month", "source_file")
BATCH_NUMBERS = ("amount", "fee", "settlement")
SELLOUT_COLUMNS = (
    "order_id", "shop_name", "warehouse_name", "order_time", "payment_time", "ship_time", "status", "amount", "freight", "quantity",
    "product_name", "product_code", "nsv", "buyer_name", "recipient_name", "logistics_no", "logistics_company",
    "source_file", "source_sheet", "month",
)
SELLOUT_NUMBERS = ("amount", "freight", "quantity", "nsv")
SELLOUT_NAMES = {
    "订单编号": "order_id",
    "交易订单号": "order_id",
    "店铺名称": "shop_name",
    "仓库名称": "warehouse_name",
    "下单时间": "order_time",
    "订单创建时间": "order_time",
    "支付时间": "payment_time",
    "订单付款时间": "payment_time",
    "发货时间": "ship_time",
    "出库时间": "ship_time",
    "出库日期": "ship_time",
    "订单状态": "status",
    "总金额": "amount",
    "买家应付货款": "amount",
    "买家实际支付金额": "amount",
    "订单金额": "amount",
    "运费": "freight",
    "买家应付邮费": "freight",
    "商品数量": "quantity",
    "宝贝总数量": "quantity",
    "宝贝标题": "product_name",
    "商品名称": "product_name",
    "货品名称": "product_name",
    "商家编码": "product_code",
    "商品编码": "product_code",
    "货品编码": "product_code",
    "NSV": "nsv",
    "买家会员名": "buyer_name",
    "买家会员昵称": "buyer_name",
    "买家昵称": "buyer_name",
    "收货人姓名": "recipient_name",
    "收件人": "recipient_name",
    "物流单号": "logistics_no",
    "配送运单号": "logistics_no",
    "物流公司": "logistics_company",
    "配送公司": "logistics_company",
}
REFUND_COLUMNS = (
    "order_id", "refund_id", "refund_time", "refund_amount", "refund_type", "need_return", "product_name", "buyer_name", "status",
    "source_file", "source_sheet", "month",
)
REFUND_NUMBERS = ("refund_amount", "amount", "quantity", "nsv")
REFUND_NAMES = {
    "退款编号": "order_id",
    "交易订单号": "order_id",
    "退款完结时间": "refund_time",
    "买家退款金额": "refund_amount",
    "退款金额": "refund_amount",
    "手工退款/系统退款": "refund_type",
    "是否需要退货": "need_return",
    "宝贝标题": "product_name",
    "货品名称": "product_name",
    "商品名称": "product_name",
    "买家会员昵称": "buyer_name",
    "买家昵称": "buyer_name",
    "状态": "status",
}
TRANSFER_COLUMNS = (
    "order_id", "erp_order_id", "transfer_id", "lp_id", "product_code", "product_name", "warehouse_name", "transfer_time", "doc_type",
    "stock_type", "merchant_code", "quantity", "nsv", "source_file", "source_sheet", "month",
)
TRANSFER_NUMBERS = ("quantity", "nsv")
TRANSFER_NAMES = {
    "交易订单号": "order_id",
    "ERP订单号": "erp_order_id",
    "单号": "transfer_id",
    "LP单号": "lp_id",
    "货品编码": "product_code",
    "货品名称": "product_name",
    "仓库名称": "warehouse_name",
    "出入库时间": "transfer_time",
    "单据类型": "doc_type",
    "库存类型": "stock_type",
    "商家编码": "merchant_code",
    "出入数量": "quantity",
    "NSV": "nsv",
}


def standardised(df: DataFrame, names: dict[str, str], standard: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """The ``standard`` columns of a raw table in their order: the first source column of each, blank where there is none.

    Numbers are decimals with 4 places, 0 where they cannot be read, and null where the table has no such column.
    """
    named = rename_columns(df, names)
    have = set(named.columns)

    def column(c: str):
        if c in numbers:
            return parse_amount_platform(c) if c in have else F.lit(None).cast("decimal(20,4)")
        return F.col(c) if c in have else F.lit("")

    return named.select(*[column(c).alias(c) for c in standard])


def _settlement_names(df: DataFrame) -> DataFrame:
    return rename_columns(df, {c: standard_name(c) for c in df.columns})


def clean_settlement(df: DataFrame) -> DataFrame:
    """Transactions of a settlement file as 17 columns."""
    return standardised(_settlement_names(df), SETTLEMENT_NAMES, SETTLEMENT_COLUMNS, SETTLEMENT_NUMBERS)


def clean_settlement_batches(df: DataFrame) -> DataFrame:
    """Settlement batches as 8 columns."""
    return standardised(_settlement_names(df), {}, BATCH_COLUMNS, BATCH_NUMBERS)


def clean_sellout(df: DataFrame) -> DataFrame:
    """A shipment sheet of either layout as 20 columns."""
    return standardised(df, SELLOUT_NAMES, SELLOUT_COLUMNS, SELLOUT_NUMBERS)


def clean_refund(df: DataFrame) -> DataFrame:
    """A refund or return sheet, in the refund layout or in that of shipments: the refund columns, then the other shipment columns."""
    standard = tuple(dict.fromkeys(REFUND_COLUMNS + SELLOUT_COLUMNS))
    return standardised(df, SELLOUT_NAMES | REFUND_NAMES, standard, REFUND_NUMBERS)


def clean_transfer(df: DataFrame) -> DataFrame:
    """A sheet of transfers back to the bonded warehouse as 16 columns."""
    return standardised(df, TRANSFER_NAMES, TRANSFER_COLUMNS, TRANSFER_NUMBERS)
