"""Statements for the cube measures and the printed reports."""

from __future__ import annotations

from oracles.layout import money, over

SALES = """FactSales f JOIN DimProduct dp ON f.ProductKey = dp.ProductKey
    JOIN DimCustomer dc ON f.CustomerKey = dc.CustomerKey JOIN DimLocation dl ON dc.LocationKey = dl.LocationKey
    JOIN DimDate d ON f.InvoiceDateKey = d.DateKey"""
SALES_TABLES = ("FactSales", "DimProduct", "DimCustomer", "DimLocation", "DimDate")
BUYS = """FactPurchases f JOIN DimProduct dp ON f.ProductKey = dp.ProductKey
    JOIN DimSupplier ds ON f.SupplierKey = ds.SupplierKey JOIN DimLocation dl ON ds.LocationKey = dl.LocationKey
    JOIN DimDate d ON f.PurchaseDateKey = d.DateKey"""
BUYS_TABLES = ("FactPurchases", "DimProduct", "DimSupplier", "DimLocation", "DimDate")
MOVES = """FactInventoryTransactions f JOIN DimProduct dp ON f.ProductKey = dp.ProductKey
    JOIN DimDate d ON f.DateKey = d.DateKey"""
MOVES_TABLES = ("FactInventoryTransactions", "DimProduct", "DimDate")
PAYS = """FactFinancialTransactions f LEFT JOIN DimCustomer dc ON f.CustomerKey = dc.CustomerKey
    LEFT JOIN DimSupplier ds ON f.SupplierKey = ds.SupplierKey
    LEFT JOIN DimLocation cl ON dc.LocationKey = cl.LocationKey
    LEFT JOIN DimLocation sl ON ds.LocationKey = sl.LocationKey"""
PAYS_TABLES = ("FactFinancialTransactions", "DimCustomer", "DimSupplier", "DimLocation")

REVENUE, PROFIT = money("SUM(f.LineTotal)"), money("SUM(f.ProfitAmount)")
MARGIN = f"CASE WHEN SUM(f.LineTotal) <> 0 THEN {PROFIT} / {REVENUE} END"
COST = money("SUM(f.LineCost)")
LINES = "COUNT(*) AS line_count"
INVOICES = "COUNT(DISTINCT f.InvoiceID)"
AVERAGE = f"{REVENUE} / CAST({INVOICES} AS DOUBLE)"
FULL_NAME, DELIVERY = "f.EmployeeKey AS FullName", "f.DeliveryMethodKey AS DeliveryMethod"
KIND = "f.TransactionTypeKey AS TransactionType"


def whole(column: str) -> str:
    return f"CAST(SUM({column}) AS BIGINT)"


def ids(column: str) -> str:
    return money(f"SUM(CAST({column} AS DECIMAL(20,0)))")


def grouped(columns: str, measures: str, source: str, tables: tuple[str, ...], where: str = "1=1") -> str:
    plain = ", ".join(c.split(" AS ")[0] for c in columns.split(", "))
    return over(f"SELECT {columns}, {measures} FROM {source} WHERE {where} GROUP BY {plain}", *tables)


def changes(cell: str, where: str = "1=1", keep: str = "1=1", columns: str = "") -> str:
    """Quantities in and out, netted per product within the cell."""
    names = ", ".join(c.split(" AS ")[-1].split(".")[-1] for c in cell.split(", "))
    plain = ", ".join(c.split(" AS ")[0] for c in cell.split(", "))
    shown = columns or """CAST(COALESCE(SUM(CASE WHEN q > 0 THEN q END), 0) AS BIGINT) AS qty_in,
        CAST(COALESCE(SUM(CASE WHEN q < 0 THEN -q END), 0) AS BIGINT) AS qty_out,
        CAST(SUM(q) AS BIGINT) AS net_stock_change"""
    return over(
        f"""SELECT {names}, {shown} FROM (
                SELECT {cell}, f.ProductKey, SUM(f.Quantity) AS q FROM {MOVES} WHERE {where}
                GROUP BY {plain}, f.ProductKey) WHERE {keep} GROUP BY {names}""", *MOVES_TABLES)


MONTHS = "d.YearNumber, d.MonthNumber, d.MonthYear"


def over_months(measures: str, source: str, tables: tuple[str, ...]) -> str:
    return over(f"SELECT d.MonthYear, {measures} FROM {source} GROUP BY {MONTHS}", *tables)


def members(column: str, source: str, table: str) -> str:
    return over(f"SELECT DISTINCT CAST({column} AS VARCHAR) AS member FROM {source}", table)


BY_ROW = """CAST(SUM(CASE WHEN f.Quantity > 0 THEN f.Quantity ELSE 0 END) AS BIGINT) AS qty_in,
    CAST(SUM(CASE WHEN f.Quantity < 0 THEN -f.Quantity ELSE 0 END) AS BIGINT) AS qty_out,
    CAST(SUM(f.Quantity) AS BIGINT) AS net_stock_change"""

STATEMENTS = {
    "sales_measures": grouped(
        "d.YearNumber, dp.Category",
        f"""{ids('f.InvoiceID')} AS sum_invoice_id, {whole('f.Quantity')} AS sum_quantity,
            {money('SUM(f.UnitPrice)')} AS sum_unit_price, {money('SUM(f.TaxRate)')} AS sum_tax_rate,
            {REVENUE} AS sum_line_total, {PROFIT} AS sum_profit, {LINES}, {REVENUE} AS total_revenue,
            {PROFIT} AS total_profit, {INVOICES} AS invoice_count""", SALES, SALES_TABLES),
    "purchase_measures": grouped(
        "d.YearNumber, ds.SupplierCategory",
        f"""{ids('f.PurchaseOrderID')} AS sum_purchase_order_id, {whole('f.QuantityOrdered')} AS sum_quantity_ordered,
            {money('SUM(f.UnitCostPrice)')} AS sum_unit_cost, {LINES}, {COST} AS total_purchase_cost""",
        BUYS, BUYS_TABLES),
    "inventory_measures": grouped(
        f"d.YearNumber, {KIND}",
        f"""{ids('f.InvoiceID')} AS sum_invoice_id, {ids('f.PurchaseOrderID')} AS sum_purchase_order_id,
            {whole('f.Quantity')} AS sum_quantity, COUNT(*) AS transaction_count""", MOVES, MOVES_TABLES),
    "financial_measures": grouped(
        f"f.TransactionSource, {KIND}",
        f"""{ids('f.InvoiceID')} AS sum_invoice_id, {ids('f.PurchaseOrderID')} AS sum_purchase_order_id,
            {money('SUM(f.NetAmount)')} AS sum_net, {money('SUM(f.TaxAmount)')} AS sum_tax,
            {money('SUM(f.TransactionAmount)')} AS sum_amount, {money('SUM(f.RemainingBalance)')} AS sum_balance,
            COUNT(*) AS transaction_count""", "FactFinancialTransactions f", PAYS_TABLES),
    "profit_margin": grouped("dp.Category", f"{MARGIN} AS profit_margin", SALES, SALES_TABLES),
    "avg_revenue_per_invoice": grouped("d.YearNumber", f"{AVERAGE} AS avg_revenue_per_invoice", SALES, SALES_TABLES),
    "qty_in_out": changes("d.YearNumber, dp.Category"),
    "qty_in": changes("d.YearNumber, dp.Category",
                      columns="CAST(COALESCE(SUM(CASE WHEN q > 0 THEN q END), 0) AS BIGINT) AS qty_in"),
    "qty_out": changes("d.YearNumber, dp.Category",
                       columns="CAST(COALESCE(SUM(CASE WHEN q < 0 THEN -q END), 0) AS BIGINT) AS qty_out"),
    "net_stock_change": changes("d.YearNumber, dp.Category", columns="CAST(SUM(q) AS BIGINT) AS net_stock_change"),
    "qty_in_out_by_row": grouped("d.YearNumber, dp.Category", BY_ROW, MOVES, MOVES_TABLES),
    "receivables": grouped(
        KIND, f"{money('''SUM(CASE WHEN f.TransactionSource = 'Customer' THEN f.TransactionAmount END)''')} AS receivables",
        "FactFinancialTransactions f", PAYS_TABLES),
    "payables": grouped(
        KIND, f"{money('''SUM(CASE WHEN f.TransactionSource = 'Supplier' THEN f.TransactionAmount END)''')} AS payables",
        "FactFinancialTransactions f", PAYS_TABLES),
    "cube_slice": grouped(
        "dp.Brand, dp.Category, dl.Country, d.QuarterName, d.YearNumber",
        f"""{REVENUE} AS revenue, {PROFIT} AS profit, {INVOICES} AS invoice_count, {MARGIN} AS profit_margin,
            {AVERAGE} AS avg_revenue_per_invoice""", SALES, SALES_TABLES,
        "d.YearNumber IN (1997, 1998) AND dp.Category IN ('PROMO', 'SMALL', 'LARGE')"),
    "cube_slice_purchases": grouped(
        "dl.City, dl.Country, dp.Brand, dp.Category, ds.SupplierName, ds.SupplierCategory",
        f"{LINES}, {whole('f.QuantityOrdered')} AS sum_quantity_ordered, {COST} AS total_purchase_cost",
        BUYS, BUYS_TABLES),
    "cube_totals": over(
        f"""SELECT d.YearNumber, dp.Category, dc.CustomerCategory,
                   CAST(GROUPING_ID(d.YearNumber, dp.Category, dc.CustomerCategory) AS BIGINT) AS level,
                   {REVENUE} AS revenue, {PROFIT} AS profit, {whole('f.Quantity')} AS sum_quantity
            FROM {SALES} GROUP BY CUBE (d.YearNumber, dp.Category, dc.CustomerCategory)""", *SALES_TABLES),
    "rollup_totals": over(
        f"""SELECT d.YearNumber, d.QuarterName, d.MonthNumber,
                   CAST(GROUPING_ID(d.YearNumber, d.QuarterName, d.MonthNumber) AS BIGINT) AS level,
                   {REVENUE} AS revenue
            FROM {SALES} GROUP BY ROLLUP (d.YearNumber, d.QuarterName, d.MonthNumber)""", *SALES_TABLES),
    "grouping_sets_totals": over(
        f"""SELECT dp.Category, ds.SupplierCategory,
                   CAST(GROUPING_ID(dp.Category, ds.SupplierCategory) AS BIGINT) AS level, {COST} AS cost
            FROM {BUYS} GROUP BY GROUPING SETS ((dp.Category), (ds.SupplierCategory), ())""", *BUYS_TABLES),
    "role_dates": grouped(
        "d.MonthYear, e.MonthYear AS ExpectedMonthYear", f"{COST} AS cost, {LINES}",
        """FactPurchases f JOIN DimDate d ON f.PurchaseDateKey = d.DateKey
           JOIN DimDate e ON f.ExpectedDeliveryDateKey = e.DateKey""", BUYS_TABLES),
    "reference_dims": over(
        f"""SELECT COALESCE(cl.Country, 'Unknown') AS CustomerCountry, COALESCE(sl.Country, 'Unknown') AS SupplierCountry,
                   {money('SUM(f.TransactionAmount)')} AS amount, COUNT(*) AS transaction_count
            FROM {PAYS} GROUP BY cl.Country, sl.Country""", *PAYS_TABLES),
    "sales_by_salesperson": over(
        f"""SELECT f.EmployeeKey <> '4-NOT SPECIFIED' AS IsSalesperson, f.DeliveryMethodKey AS DeliveryMethod,
                   {REVENUE} AS revenue, COUNT(*) AS line_count FROM FactSales f GROUP BY ALL""", "FactSales"),
    "payments_by_method": over(
        f"""SELECT COALESCE(f.PaymentMethodKey, 'Unknown') AS PaymentMethod, f.TransactionTypeKey AS TransactionType,
                   COALESCE(cl.Country, 'Unknown') AS CustomerCountry, {money('SUM(f.TransactionAmount)')} AS amount,
                   {money('SUM(f.RemainingBalance)')} AS balance FROM {PAYS} GROUP BY ALL""", *PAYS_TABLES),
    "degenerate_dim": grouped(
        "f.TransactionSource", f"{money('SUM(f.TransactionAmount)')} AS amount, COUNT(*) AS transaction_count",
        "FactFinancialTransactions f", PAYS_TABLES),
    "unknown_member": over(
        f"""SELECT COALESCE(dc.CustomerCategory, 'Unknown') AS CustomerCategory,
                   COALESCE(ds.SupplierCategory, 'Unknown') AS SupplierCategory,
                   {money('SUM(f.TransactionAmount)')} AS amount
            FROM {PAYS} GROUP BY dc.CustomerCategory, ds.SupplierCategory""", *PAYS_TABLES),
    "sales_details": grouped(
        f"dc.CustomerName, d.MonthNumber, {DELIVERY}, {FULL_NAME}, dl.City, dp.Product, dp.Category",
        f"""{REVENUE} AS total_revenue, {PROFIT} AS total_profit, {money('SUM(f.UnitPrice)')} AS sum_unit_price,
            {whole('f.Quantity')} AS sum_quantity, {AVERAGE} AS avg_revenue_per_invoice, {MARGIN} AS profit_margin""",
        SALES, SALES_TABLES,
        """d.YearNumber IN (1997, 1998) AND d.MonthNumber IN (1, 2, 3)
           AND dc.CustomerCategory IN ('BUILDING', 'MACHINERY')"""),
    "purchase_details": grouped(
        f"ds.SupplierName, dp.Category, dp.Product, {DELIVERY}, dl.City",
        f"{COST} AS total_purchase_cost, {money('SUM(f.UnitCostPrice)')} AS sum_unit_cost", BUYS, BUYS_TABLES,
        "d.YearNumber IN (1997, 1998) AND d.MonthNumber IN (1, 2, 3) AND ds.SupplierCategory IN ('Preferred')"),
    "inventory_details": changes(
        f"dp.Product, {KIND}",
        "d.YearNumber IN (1997, 1998) AND d.MonthNumber IN (1, 2, 3) AND dp.Category IN ('PROMO', 'SMALL')"),
    "filter_values": members("YearNumber", "DimDate", "DimDate") + " UNION ALL SELECT 'All'",
    "filter_values_month": members("MonthNumber", "DimDate", "DimDate"),
    "filter_values_category": members("CustomerCategory", "DimCustomer", "DimCustomer"),
    "profit_by_customer_category": grouped("dc.CustomerCategory", f"{PROFIT} AS profit", SALES, SALES_TABLES),
    "top_salesmen": over(
        f"""SELECT FullName, CAST(revenue AS DOUBLE) AS revenue FROM (
                SELECT f.EmployeeKey AS FullName, SUM(f.LineTotal) AS revenue,
                       RANK() OVER (ORDER BY SUM(f.LineTotal) DESC) AS place
                FROM FactSales f GROUP BY f.EmployeeKey) WHERE place <= 5""", "FactSales"),
    "sales_over_time": over_months(f"{REVENUE} AS revenue, {PROFIT} AS profit", SALES, SALES_TABLES),
    "margin_by_category": over(
        f"""SELECT Category, CAST(SUM(p) AS DOUBLE) / CAST(SUM(r) AS DOUBLE) AS profit_margin,
                   ROUND(SUM(CAST(p AS DOUBLE) / NULLIF(CAST(r AS DOUBLE), 0)), 4) AS margin_sum
            FROM (SELECT dp.Category, SUM(f.ProfitAmount) AS p, SUM(f.LineTotal) AS r FROM {SALES}
                  GROUP BY dp.Brand, dp.Category, dl.City, dl.Country, d.MonthName, d.QuarterName, d.YearNumber,
                           d.MonthYear, dc.CustomerCategory, dc.CustomerName, f.EmployeeKey, dp.Product)
            GROUP BY Category""", *SALES_TABLES),
    "orders_by_supplier_category": grouped("ds.SupplierCategory", LINES, BUYS, BUYS_TABLES),
    "top_ordered_products": over(
        f"""SELECT Product, quantity FROM (
                SELECT dp.Product, {whole('f.QuantityOrdered')} AS quantity,
                       RANK() OVER (ORDER BY SUM(f.QuantityOrdered) DESC) AS place
                FROM {BUYS} GROUP BY dp.Product) WHERE place <= 5""", *BUYS_TABLES),
    "purchases_over_time": over_months(f"{COST} AS cost, {LINES}", BUYS, BUYS_TABLES),
    "cost_by_category": grouped("dp.Category", f"{COST} AS cost", BUYS, BUYS_TABLES),
    "quantities_over_time": over(
        f"""SELECT MonthYear, CAST(SUM(CASE WHEN q > 0 THEN q ELSE 0 END) AS BIGINT) AS qty_in,
                   CAST(SUM(CASE WHEN q < 0 THEN -q ELSE 0 END) AS BIGINT) AS qty_out
            FROM (SELECT {MONTHS}, f.ProductKey, SUM(f.Quantity) AS q FROM {MOVES} GROUP BY {MONTHS}, f.ProductKey)
            GROUP BY MonthYear""", *MOVES_TABLES),
    "purchase_vs_sale": over(
        """SELECT COUNT(DISTINCT PurchaseOrderID) AS purchase_orders, COUNT(DISTINCT InvoiceID) AS invoices
           FROM FactInventoryTransactions""", "FactInventoryTransactions"),
    "category_quantities": changes("dp.Category", keep="lower(Category) <> 'unknown'"),
    "transactions_over_time": over_months("COUNT(*) AS transaction_count", MOVES, MOVES_TABLES),
}
