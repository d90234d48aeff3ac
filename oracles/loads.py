"""Statements for cleaning, validation, dimensions, facts, upkeep and file round trips."""

from __future__ import annotations

from oracles.layout import ORDER_KEY, UNIT_PRICE, money, over

MARK = 19980630
SALES_ROWS = """SELECT InvoiceDateKey, ProductKey, InvoiceID, CustomerKey, EmployeeKey, DeliveryMethodKey, Quantity,
    CAST(UnitPrice AS DOUBLE) AS UnitPrice, CAST(TaxRate AS DOUBLE) AS TaxRate, CAST(LineTotal AS DOUBLE) AS LineTotal,
    CAST(ProfitAmount AS DOUBLE) AS ProfitAmount FROM FactSales"""
PURCHASE_ROWS = """SELECT PurchaseDateKey, ExpectedDeliveryDateKey, PurchaseOrderID, ProductKey, SupplierKey,
    DeliveryMethodKey, QuantityOrdered, CAST(UnitCostPrice AS DOUBLE) AS UnitCostPrice,
    CAST(TaxRate AS DOUBLE) AS TaxRate FROM FactPurchases"""
MOVE_ROWS = """SELECT DateKey, ProductKey, TransactionTypeKey, InvoiceID, PurchaseOrderID, Quantity
    FROM FactInventoryTransactions"""
STOCK_ROWS = """SELECT ProductKey, CurrentStock, ReorderLevel, TargetStockLevel,
    CAST(LastCostPrice AS DOUBLE) AS LastCostPrice FROM FactInventory"""
PAYMENT_ROWS = """SELECT CASE WHEN DateKey IN (SELECT DateKey FROM DimDate) THEN DateKey END AS DateKey, CustomerKey, SupplierKey,
    InvoiceID, PurchaseOrderID, PaymentMethodKey, TransactionTypeKey, TransactionSource,
    CAST(NetAmount AS DOUBLE) AS NetAmount, CAST(TaxAmount AS DOUBLE) AS TaxAmount,
    CAST(TransactionAmount AS DOUBLE) AS TransactionAmount,
    CAST(RemainingBalance AS DOUBLE) AS RemainingBalance
    FROM FactFinancialTransactions"""
BY_MONTH = over(
    f"""SELECT CAST(InvoiceDateKey // 100 AS INT) AS month, COUNT(*) AS line_count, {money('SUM(LineTotal)')} AS revenue
        FROM FactSales GROUP BY InvoiceDateKey // 100""", "FactSales")

# The stock before and now, as the upkeep queries take it.
STOCKS = """WITH before AS (
    SELECT f.* REPLACE (CAST(f.CurrentStock + CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS INT) AS CurrentStock)
    FROM FactInventory f JOIN part ON p_partkey = ProductKey WHERE p_type <> 'PROMO'),
now AS (SELECT f.* FROM FactInventory f JOIN part ON p_partkey = ProductKey WHERE p_type <> 'ECONOMY')"""
UPSERTED = STOCKS + """
SELECT ProductKey, CurrentStock, ReorderLevel, TargetStockLevel, CAST(LastCostPrice AS DOUBLE) AS LastCostPrice FROM now
UNION ALL
SELECT ProductKey, CurrentStock, ReorderLevel, TargetStockLevel, CAST(LastCostPrice AS DOUBLE)
FROM before WHERE ProductKey NOT IN (SELECT ProductKey FROM now)"""
VERSIONS = STOCKS + """,
sides AS (
    SELECT COALESCE(b.ProductKey, n.ProductKey) AS ProductKey, b.ProductKey AS had, n.ProductKey AS has,
           b.CurrentStock AS s0, b.ReorderLevel AS r0, n.CurrentStock AS s1, n.ReorderLevel AS r1
    FROM before b FULL JOIN now n ON b.ProductKey = n.ProductKey),
versions AS (
    SELECT ProductKey, s0 AS CurrentStock, r0 AS ReorderLevel, DATE '2000-01-01' AS validFrom,
           CASE WHEN has IS NOT NULL AND (s0 <> s1 OR r0 <> r1) THEN DATE '2000-02-01' END AS validTo,
           NOT (has IS NOT NULL AND (s0 <> s1 OR r0 <> r1)) AS isCurrent
    FROM sides WHERE had IS NOT NULL
    UNION ALL
    SELECT ProductKey, s1, r1, DATE '2000-02-01', NULL, TRUE FROM sides
    WHERE has IS NOT NULL AND (had IS NULL OR s0 <> s1 OR r0 <> r1))"""

LABEL = """CASE WHEN {0} >= 1000000 THEN printf('$%.1fM', {0} / 1000000) WHEN {0} >= 1000
    THEN printf('$%.1fK', {0} / 1000) ELSE format('${{:,.2f}}', {0}) END"""


def rule(table: str, kind: str, column: str, violations: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{kind}' AS rule, '{column}' AS column_name,
        CAST(COALESCE(({violations}), 0) AS BIGINT) AS violations"""


def key_rule(table: str, *key: str) -> str:
    columns = ", ".join(key)
    return rule(table, "primary_key", columns,
                f"SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {columns} HAVING COUNT(*) > 1)")


def row_rule(table: str, kind: str, column: str, condition: str) -> str:
    return rule(table, kind, column, f"SELECT COUNT(*) FROM {table} WHERE {condition}")


def null_rules(table: str, *columns: str) -> list[str]:
    return [row_rule(table, "not_null", c, f"{c} IS NULL") for c in columns]


def foreign_rule(table: str, column: str, parent: str, key: str) -> str:
    return row_rule(table, "foreign_key", column,
                    f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})")


def length_rule(table: str, column: str, length: int) -> str:
    return row_rule(table, "length", column, f"length({column}) > {length}")


CONSTRAINTS = [
    key_rule("region", "r_regionkey"), *null_rules("region", "r_name"), length_rule("region", "r_name", 100),
    key_rule("nation", "n_nationkey"), *null_rules("nation", "n_name", "n_regionkey"),
    foreign_rule("nation", "n_regionkey", "region", "r_regionkey"),
    key_rule("customer", "c_custkey"), *null_rules("customer", "c_name", "c_mktsegment", "c_nationkey"),
    row_rule("customer", "check", "balance_not_negative", "NOT (c_acctbal >= 0)"),
    length_rule("customer", "c_name", 100), length_rule("customer", "c_mktsegment", 8),
    foreign_rule("customer", "c_nationkey", "nation", "n_nationkey"),
    key_rule("supplier", "s_suppkey"), *null_rules("supplier", "s_name", "s_nationkey"),
    length_rule("supplier", "s_name", 100), foreign_rule("supplier", "s_nationkey", "nation", "n_nationkey"),
    key_rule("part", "p_partkey"), *null_rules("part", "p_name", "p_type"),
    row_rule("part", "check", "size_at_most_40", "NOT (p_size <= 40)"), length_rule("part", "p_name", 150),
    length_rule("part", "p_brand", 100),
    key_rule("orders", "o_orderkey"), *null_rules("orders", "o_custkey", "o_orderdate", "o_orderpriority"),
    foreign_rule("orders", "o_custkey", "customer", "c_custkey"),
    key_rule("lineitem", "l_orderkey", "l_linenumber"),
    *null_rules("lineitem", "l_orderkey", "l_partkey", "l_quantity"),
    row_rule("lineitem", "check", "quantity_positive", "NOT (l_quantity > 0)"),
    foreign_rule("lineitem", "l_orderkey", "orders", "o_orderkey"),
    foreign_rule("lineitem", "l_partkey", "part", "p_partkey"),
    foreign_rule("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]

REJECTS = """WITH one AS (
    SELECT l_orderkey, MAX(l_partkey) AS l_partkey, MAX(l_quantity) AS l_quantity, MAX(l_returnflag) AS l_returnflag
    FROM lineitem GROUP BY l_orderkey),
given AS (
    SELECT 'lines' AS load_id, l_orderkey, l_partkey, l_quantity, COUNT(*) OVER (PARTITION BY l_orderkey) AS copies FROM lineitem
    UNION ALL SELECT 'orders', l_orderkey, l_partkey, l_quantity, 1 FROM one)
SELECT load_id, concat_ws('; ', CASE WHEN copies > 1 THEN 'primary_key l_orderkey' END,
        CASE WHEN NOT l_quantity > 5 THEN 'check quantity_above_5' END,
        CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01')
             THEN 'foreign_key l_orderkey' END,
        CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'foreign_key l_partkey' END) AS reasons,
    COUNT(*) AS row_total
FROM given GROUP BY ALL"""

STATEMENTS = {
    "table_source": """SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS o_orderdate
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "csv_source": """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
        FROM orders""",
    "limited_fetch": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "clean_values": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(o_orderdate AS DATE) END
            AS OrderDate, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS Amount,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS Priority FROM orders""",
    "project_rename": "SELECT c_custkey AS CustomerID, c_name AS CustomerName, c_nationkey AS CityID FROM customer",
    "employee_filter": """SELECT DISTINCT o_orderpriority AS EmployeeID, o_orderpriority AS FullName,
        o_orderpriority <> '4-NOT SPECIFIED' AS IsSalesperson FROM orders""",
    "first_category": "SELECT l_partkey AS StockItemID, MIN(l_suppkey) AS StockGroupID FROM lineitem GROUP BY l_partkey",
    "product_conform": """SELECT p_partkey AS StockItemID, p_name AS StockItemName, StockGroupID FROM part LEFT JOIN
        (SELECT l_partkey, MIN(l_suppkey) AS StockGroupID FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "order_line_amounts": f"""SELECT OrderID, StockItemID, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice,
            CAST(TaxRate AS DOUBLE) AS TaxRate, CAST(Quantity * UnitPrice AS DOUBLE) AS LineTotal,
            CAST((UnitPrice - CAST(p_retailprice AS DECIMAL(18,2))) * Quantity AS DOUBLE) AS ProfitAmount
        FROM (SELECT l_orderkey AS OrderID, l_partkey AS StockItemID, CAST(l_quantity AS INT) AS Quantity,
                     CAST({UNIT_PRICE} AS DECIMAL(18,2)) AS UnitPrice, CAST(l_tax AS DECIMAL(5,2)) * 100 AS TaxRate
              FROM lineitem) LEFT JOIN part ON p_partkey = StockItemID""",
    "constraint_report": " UNION ALL ".join(CONSTRAINTS),
    "cast_columns": over(
        """SELECT DateKey, strftime(FullDate, '%Y-%m-%d') AS FullDate, MonthName, QuarterName,
                  CAST(YearNumber AS VARCHAR) AS YearNumber FROM DimDate""", "DimDate"),
    "dedupe": """SELECT p_name, MIN(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand
        FROM part GROUP BY p_name""",
    "dim_date": over("SELECT * FROM DimDate", "DimDate"),
    "fixed_calendar": """SELECT CAST(year(o_orderdate) AS INT) AS YearNumber, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS days,
        COUNT(*) AS orders FROM orders WHERE CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-03-01' AND DATE '1998-12-31' GROUP BY year(o_orderdate)""",
    "dim_location": over("SELECT CityID, City, State, Country, Continent FROM DimLocation", "DimLocation"),
    "dim_customer": over("SELECT * EXCLUDE (CustomerKey) FROM DimCustomer", "DimCustomer"),
    "dim_supplier": over("SELECT * EXCLUDE (SupplierKey) FROM DimSupplier", "DimSupplier"),
    "dim_product": over(
        """SELECT ProductID, Product, Category, Color, Brand, CAST(LastCostPrice AS DOUBLE) AS LastCostPrice
           FROM DimProduct""", "DimProduct"),
    "dim_employee": """SELECT DISTINCT o_orderpriority AS EmployeeID, o_orderpriority AS FullName,
        o_orderpriority <> '4-NOT SPECIFIED' AS IsSalesperson FROM orders""",
    "dim_delivery_method": "SELECT DISTINCT l_linestatus AS DeliveryMethodID, l_linestatus AS DeliveryMethod FROM lineitem",
    "dim_transaction_type": """SELECT l_returnflag AS TransactionTypeID, l_returnflag AS TransactionType FROM lineitem
        UNION SELECT o_orderstatus, o_orderstatus FROM orders""",
    "dim_payment_method": """SELECT DISTINCT o_orderpriority AS PaymentMethodID, o_orderpriority AS PaymentMethod
        FROM orders""",
    "surrogate_key": """SELECT c_mktsegment, COUNT(*) AS members, COUNT(*) AS distinct_keys,
            CAST(SUM(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS stayed,
            CAST(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS added
        FROM customer GROUP BY c_mktsegment""",
    "loaded_sales": over(SALES_ROWS, "FactSales"),
    "loaded_purchases": over(PURCHASE_ROWS, "FactPurchases"),
    "loaded_movements": over(MOVE_ROWS, "FactInventoryTransactions"),
    "loaded_payments": over(PAYMENT_ROWS, "FactFinancialTransactions", "DimDate"),
    "loaded_stock": over(STOCK_ROWS, "FactInventory"),
    "history_lookup": over(
        VERSIONS + """ SELECT CAST(InvoiceDateKey // 10000 AS INT) AS YearNumber, validFrom, COUNT(*) AS lines,
            CAST(SUM(Quantity) AS BIGINT) AS quantity, CAST(SUM(CurrentStock) AS BIGINT) AS stock,
            CAST(SUM(ReorderLevel) AS BIGINT) AS reorder
        FROM FactSales f LEFT JOIN versions v ON v.ProductKey = f.ProductKey
            AND strptime(CAST(InvoiceDateKey AS VARCHAR), '%Y%m%d') >= validFrom
            AND (validTo IS NULL OR strptime(CAST(InvoiceDateKey AS VARCHAR), '%Y%m%d') < validTo)
        GROUP BY InvoiceDateKey // 10000, validFrom""", "FactInventory", "FactSales"),
    "lookup": over(
        """SELECT SupplierKey AS SupplierID, COUNT(*) AS lines, MAX(ExpectedDeliveryDateKey) AS last_key
           FROM FactPurchases GROUP BY SupplierKey""", "FactPurchases"),
    "lookup_keep": over(
        """SELECT MonthYear, COUNT(*) AS lines FROM lineitem LEFT JOIN DimDate ON CAST(l_shipdate AS DATE) = FullDate
           GROUP BY MonthYear""", "DimDate"),
    "fact_sales": over(SALES_ROWS, "FactSales"),
    "fact_purchases": over(PURCHASE_ROWS, "FactPurchases"),
    "fact_inventory": over(STOCK_ROWS, "FactInventory"),
    "fact_inventory_transactions": over(MOVE_ROWS, "FactInventoryTransactions"),
    "fact_financial": over(PAYMENT_ROWS, "FactFinancialTransactions", "DimDate"),
    "incremental_fact": over(f"{SALES_ROWS} WHERE InvoiceDateKey > {MARK}", "FactSales"),
    "incremental_purchases": over(f"{PURCHASE_ROWS} WHERE PurchaseDateKey > {MARK}", "FactPurchases"),
    "incremental_movements": over(f"{MOVE_ROWS} WHERE DateKey > {MARK}", "FactInventoryTransactions"),
    "incremental_with_lookback": over(
        f"""{SALES_ROWS} WHERE InvoiceDateKey > {MARK}
            OR (InvoiceDateKey = {MARK} AND EmployeeKey = '1-URGENT')""", "FactSales"),
    "upsert_inventory": over(UPSERTED, "FactInventory"),
    "change_set": over(
        STOCKS + """ SELECT COALESCE(b.ProductKey, n.ProductKey) AS ProductKey,
            CASE WHEN b.ProductKey IS NULL THEN 'new' WHEN n.ProductKey IS NULL THEN 'missing'
                 WHEN b.CurrentStock = n.CurrentStock THEN 'unchanged' ELSE 'changed' END AS change
        FROM before b FULL JOIN now n ON b.ProductKey = n.ProductKey""", "FactInventory"),
    "dim_history": over(VERSIONS + " SELECT * FROM versions", "FactInventory"),
    "current_rows": over(
        VERSIONS + " SELECT ProductKey, CurrentStock, validFrom FROM versions WHERE isCurrent", "FactInventory"),
    "append_sink": BY_MONTH,
    "reload_sink": """SELECT CAST(year(o_orderdate) AS INT) AS YearNumber, o_orderpriority AS EmployeeKey, COUNT(*) AS orders
        FROM orders WHERE year(o_orderdate) <> 1998 OR o_orderpriority = '1-URGENT' GROUP BY ALL""",
    "watermark_store": f"""SELECT unnest(['FactSales', 'FactPurchases']) AS TableName,
            CAST(MAX(o_orderdate) AS DATE) AS LastLoadDate FROM orders
        UNION ALL SELECT 'FactInventoryTransactions', CAST(MAX(o_orderdate) AS DATE) FROM orders
        WHERE {ORDER_KEY} <= {MARK}""",
    "stored_upsert": over(UPSERTED, "FactInventory"),
    "bucketed_upsert": over(UPSERTED, "FactInventory"),
    "change_feed": """SELECT o_custkey AS CustomerID, arg_max(o_orderpriority, o_orderkey) AS Priority,
            arg_max(o_totalprice, o_orderkey) AS Amount
        FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'""",
    "append_with_rejects": REJECTS,
    "stream_fact_sales": BY_MONTH,
    "money_label": f"""SELECT c_mktsegment AS CustomerCategory, o_orderpriority AS EmployeeKey,
            {LABEL.format('a')} AS total, {LABEL.format('b')} AS largest
        FROM (SELECT c_mktsegment, o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS a,
                     MAX(o_totalprice) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
}
