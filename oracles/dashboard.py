"""Statements for the dashboard and the monthly report."""

from __future__ import annotations

from oracles.layout import COST_AT_LAST, money, over

REVENUE, PROFIT = money("SUM(f.LineTotal)"), money("SUM(f.ProfitAmount)")
SPEND = money(f"SUM({COST_AT_LAST})")
ON_DATE = "JOIN DimDate d ON f.InvoiceDateKey = d.DateKey"
ON_PRODUCT = "JOIN DimProduct dp ON f.ProductKey = dp.ProductKey"
ON_CUSTOMER = "JOIN DimCustomer dc ON f.CustomerKey = dc.CustomerKey"
PURCHASES = """FactPurchases fp JOIN DimSupplier ds ON fp.SupplierKey = ds.SupplierKey
    JOIN DimProduct dp ON fp.ProductKey = dp.ProductKey JOIN DimDate d ON fp.PurchaseDateKey = d.DateKey"""
STOCK = "FactInventory fi JOIN DimProduct dp ON fi.ProductKey = dp.ProductKey"
PERIOD = "d.MonthName || ' ' || d.YearNumber AS period, d.YearNumber AS yr, d.MonthNumber AS mo"
BY_MONTH = "GROUP BY d.YearNumber, d.MonthNumber, d.MonthName ORDER BY d.YearNumber, d.MonthNumber"
MARGIN = """CASE WHEN {s} > 0 AND {p} <> 0
    THEN CAST(printf('%.1f', CAST({p} AS DOUBLE) / CAST({s} AS DOUBLE) * 100) AS DOUBLE) END"""
MARGIN_TEXT = """CASE WHEN {s} > 0 AND {p} <> 0
    THEN printf('%.1f%%', CAST({p} AS DOUBLE) / CAST({s} AS DOUBLE) * 100) ELSE 'N/A' END"""


def trend(measures: str, where: str = "1=1") -> str:
    return over(f"SELECT {PERIOD}, {measures} FROM FactSales f {ON_DATE} WHERE {where} {BY_MONTH}", "FactSales",
                "DimDate")


def best_products(n: int, measures: str, where: str = "1=1") -> str:
    return over(
        f"""SELECT dp.Product, {measures} FROM FactSales f {ON_PRODUCT} {ON_DATE} WHERE {where}
            GROUP BY dp.Product ORDER BY SUM(f.LineTotal) DESC, dp.Product LIMIT {n}""",
        "FactSales", "DimProduct", "DimDate")


def best_customers(n: int, where: str = "1=1") -> str:
    return over(
        f"""SELECT dc.CustomerName AS customer, {REVENUE} AS revenue FROM FactSales f {ON_CUSTOMER} {ON_DATE}
            WHERE {where} GROUP BY dc.CustomerName ORDER BY SUM(f.LineTotal) DESC, customer LIMIT {n}""",
        "FactSales", "DimCustomer", "DimDate")


def by_category(where: str = "1=1") -> str:
    return over(
        f"""SELECT dp.Category, {REVENUE} AS revenue, {PROFIT} AS profit FROM FactSales f {ON_PRODUCT} {ON_DATE}
            WHERE {where} GROUP BY dp.Category ORDER BY revenue DESC""", "FactSales", "DimProduct", "DimDate")


def best_suppliers(n: int, columns: str, where: str = "1=1") -> str:
    return over(
        f"""SELECT ds.SupplierName AS supplier, {columns} FROM {PURCHASES} WHERE {where}
            GROUP BY ds.SupplierName ORDER BY SUM({COST_AT_LAST}) DESC, supplier LIMIT {n}""",
        "FactPurchases", "DimSupplier", "DimProduct", "DimDate")


def stock(columns: str, where: str, order: str = "", n: int = 0) -> str:
    tail = f"ORDER BY {order}, dp.Product, fi.ProductKey LIMIT {n}" if n else ""
    return over(f"SELECT {columns} FROM {STOCK} WHERE {where} {tail}", "FactInventory", "DimProduct")


def spend_by_month(where: str = "1=1") -> str:
    return over(f"SELECT {PERIOD}, {SPEND} AS total_cost FROM {PURCHASES} WHERE {where} {BY_MONTH}",
                "FactPurchases", "DimSupplier", "DimProduct", "DimDate")


LOW, OVER = "fi.CurrentStock <= fi.ReorderLevel", "fi.CurrentStock > fi.TargetStockLevel"
DEFICIT, EXCESS = "fi.ReorderLevel - fi.CurrentStock", "fi.CurrentStock - fi.TargetStockLevel"
IN_MONTH = "d.YearNumber = 1998 AND d.MonthNumber = 5"
ORDERS = "COUNT(DISTINCT fp.PurchaseOrderID) AS orders"
BOTH = f"{REVENUE} AS revenue, {PROFIT} AS profit"


def report_part(section: str, label: str, value: str, source: str) -> str:
    return f"""SELECT yr, mo, '{section}' AS section, position, label, CAST(amount AS DOUBLE) AS amount FROM (
        SELECT d.YearNumber AS yr, d.MonthNumber AS mo, {label} AS label, SUM({value}) AS amount,
               CAST(ROW_NUMBER() OVER (PARTITION BY d.YearNumber, d.MonthNumber
                                  ORDER BY SUM({value}) DESC, {label}) AS INT) AS position
        FROM {source} GROUP BY d.YearNumber, d.MonthNumber, {label}) WHERE position <= 5"""


SALES_BY_MONTH = f"""SELECT d.YearNumber AS yr, d.MonthNumber AS mo, SUM(f.LineTotal) AS s, SUM(f.ProfitAmount) AS p
    FROM FactSales f {ON_DATE} GROUP BY d.YearNumber, d.MonthNumber"""

STATEMENTS = {
    "kpis": over(
        f"""SELECT CAST(s AS DOUBLE) AS total_sales, CAST(p AS DOUBLE) AS total_profit, total_orders, total_purchases,
                   {MARGIN.format(s='s', p='p')} AS profit_margin, low_stock_count
            FROM (SELECT SUM(LineTotal) AS s, SUM(ProfitAmount) AS p, COUNT(DISTINCT InvoiceID) AS total_orders
                  FROM FactSales),
                 (SELECT {SPEND} AS total_purchases
                  FROM FactPurchases fp JOIN DimProduct dp ON fp.ProductKey = dp.ProductKey),
                 (SELECT COUNT(*) AS low_stock_count FROM FactInventory fi WHERE {LOW})""",
        "FactSales", "FactPurchases", "DimProduct", "FactInventory", "DimDate"),
    "revenue_trend": trend(f"{REVENUE} AS revenue"),
    "sales_trend": trend(BOTH),
    "sales_trend_1998": trend(BOTH, "d.YearNumber = 1998"),
    "top_products_revenue": best_products(8, f"{REVENUE} AS revenue"),
    "top_products": best_products(10, BOTH),
    "top_products_1998": best_products(10, BOTH, "d.YearNumber = 1998"),
    "top_customers": best_customers(10),
    "top_customers_1998": best_customers(10, "d.YearNumber = 1998"),
    "sales_by_category": by_category(),
    "sales_by_category_1998": by_category("d.YearNumber = 1998"),
    "years": over("SELECT DISTINCT YearNumber AS year FROM DimDate ORDER BY year DESC", "DimDate"),
    "stock_alerts": stock(f"dp.Product, fi.CurrentStock, fi.ReorderLevel, {DEFICIT} AS deficit", LOW, "deficit DESC",
                          5),
    "low_stock": stock(f"dp.Product, fi.CurrentStock, fi.ReorderLevel, {DEFICIT} AS deficit", LOW, "deficit DESC", 20),
    "overstock": stock(f"dp.Product, fi.CurrentStock, fi.TargetStockLevel, {EXCESS} AS excess", OVER, "excess DESC",
                       20),
    "inventory_value": over(
        f"""SELECT dp.Category, {money('SUM(fi.CurrentStock * fi.LastCostPrice)')} AS inv_value FROM {STOCK}
            GROUP BY dp.Category ORDER BY inv_value DESC""", "FactInventory", "DimProduct"),
    "top_suppliers": best_suppliers(10, f"{SPEND} AS total_spend, {ORDERS}"),
    "top_suppliers_1998": best_suppliers(10, f"{SPEND} AS total_spend, {ORDERS}", "d.YearNumber = 1998"),
    "purchase_trend": spend_by_month(),
    "purchase_trend_1998": spend_by_month("d.YearNumber = 1998"),
    "top_purchased": over(
        f"""SELECT dp.Product, CAST(SUM(fp.QuantityOrdered) AS BIGINT) AS qty, {SPEND} AS total_cost
            FROM FactPurchases fp JOIN DimProduct dp ON fp.ProductKey = dp.ProductKey
            GROUP BY dp.Product ORDER BY SUM({COST_AT_LAST}) DESC, dp.Product LIMIT 10""",
        "FactPurchases", "DimProduct"),
    "products_sold": over(
        f"""SELECT DISTINCT dp.ProductKey, dp.Product AS product_name FROM FactSales f {ON_PRODUCT}""",
        "FactSales", "DimProduct"),
    "weekly_low_stock": stock(
        "fi.ProductKey, dp.Product, dp.Category, fi.CurrentStock, fi.ReorderLevel, fi.TargetStockLevel", LOW),
    "month_totals": over(
        f"""SELECT CAST(s AS DOUBLE) AS sales, CAST(p AS DOUBLE) AS profit, {MARGIN_TEXT.format(s='s', p='p')} AS margin
            FROM (SELECT SUM(f.LineTotal) AS s, SUM(f.ProfitAmount) AS p FROM FactSales f {ON_DATE} WHERE {IN_MONTH})""",
        "FactSales", "DimDate"),
    "month_top_products": best_products(5, f"{REVENUE} AS revenue", IN_MONTH),
    "month_top_customers": best_customers(5, IN_MONTH),
    "month_top_suppliers": best_suppliers(5, f"{SPEND} AS spend", IN_MONTH),
    "month_low_stock": stock("dp.Product, fi.CurrentStock, fi.ReorderLevel", LOW, "fi.CurrentStock", 10),
    "month_overstock": stock("dp.Product, fi.CurrentStock, fi.TargetStockLevel", OVER, f"{EXCESS} DESC", 10),
    "monthly_report": over(
        " UNION ALL ".join([
            f"""SELECT yr, mo, 'sales' AS section, 1 AS position, {MARGIN_TEXT.format(s='s', p='p')} AS label,
                       CAST(s AS DOUBLE) AS amount FROM ({SALES_BY_MONTH})""",
            f"""SELECT yr, mo, 'profit', 1, {MARGIN_TEXT.format(s='s', p='p')}, CAST(p AS DOUBLE)
                FROM ({SALES_BY_MONTH})""",
            report_part("top_products", "dp.Product", "f.LineTotal", f"FactSales f {ON_PRODUCT} {ON_DATE}"),
            report_part("top_customers", "dc.CustomerName", "f.LineTotal", f"FactSales f {ON_CUSTOMER} {ON_DATE}"),
            report_part("top_suppliers", "ds.SupplierName", COST_AT_LAST, PURCHASES),
            *(f"""SELECT CAST(NULL AS INT), CAST(NULL AS INT), '{name}', ROW_NUMBER() OVER (ORDER BY {order}, dp.Product),
                         dp.Product, CAST(fi.CurrentStock AS DOUBLE) FROM {STOCK} WHERE {where}
                  QUALIFY ROW_NUMBER() OVER (ORDER BY {order}, dp.Product, fi.ProductKey) <= 10"""
              for name, where, order in (("low_stock", LOW, "fi.CurrentStock"), ("overstock", OVER, f"{EXCESS} DESC"))),
        ]),
        "FactInventory", "FactSales", "FactPurchases", "DimProduct", "DimCustomer", "DimSupplier", "DimDate"),
    "recent_trend": over(
        f"""SELECT d.MonthName || ' ' || d.YearNumber AS period, {BOTH} FROM FactSales f {ON_DATE}
            GROUP BY d.YearNumber, d.MonthNumber, d.MonthName ORDER BY d.YearNumber DESC, d.MonthNumber DESC
            LIMIT 6""", "FactSales", "DimDate"),
    "advice_top_products": best_products(5, BOTH),
    "advice_top_customers": best_customers(5),
    "advice_top_suppliers": best_suppliers(5, f"{SPEND} AS spend"),
    "advice_low_stock": stock("dp.Product, fi.CurrentStock, fi.ReorderLevel", LOW, f"{DEFICIT} DESC", 10),
    "advice_overstock": stock("dp.Product, fi.CurrentStock, fi.TargetStockLevel", OVER, f"{EXCESS} DESC", 10),
}
