"""The given tables as the warehouse's tables, as common table expressions for DuckDB."""

from __future__ import annotations

KEY = "CAST(year({0})*10000 + month({0})*100 + day({0}) AS INT)"
ORDER_KEY = KEY.format("o_orderdate")
SHIP_KEY = KEY.format("l_shipdate")
LINE_TOTAL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))"
UNIT_PRICE = (
    "CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT) "
    "AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2))"
)

RELATIONS = {
    "DimLocation": """
        SELECT n_nationkey AS LocationKey, n_nationkey AS CityID, n_name AS City, r_name AS State,
               r_name AS Country, r_name AS Continent
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "DimCustomer": """
        SELECT c_custkey AS CustomerKey, c_custkey AS CustomerID, c_name AS CustomerName,
               c_mktsegment AS CustomerCategory, CAST(NULL AS VARCHAR) AS BuyingGroup, c_nationkey AS LocationKey
        FROM customer""",
    "DimSupplier": """
        SELECT s_suppkey AS SupplierKey, s_suppkey AS SupplierID, s_name AS SupplierName,
               CASE WHEN s_acctbal < 5000 THEN 'Standard' ELSE 'Preferred' END AS SupplierCategory,
               s_nationkey AS LocationKey
        FROM supplier""",
    "DimProduct": """
        SELECT p_partkey AS ProductKey, p_partkey AS ProductID, p_name AS Product, p_type AS Category,
               CASE WHEN p_name LIKE '% %' THEN substring(p_name, 1, position(' ' IN p_name) - 1) END AS Color,
               p_brand AS Brand, CAST(p_retailprice AS DECIMAL(18,2)) AS LastCostPrice
        FROM part""",
    "DimDate": """
        SELECT CAST(strftime(d,'%Y%m%d') AS INT) AS DateKey, d AS FullDate, CAST(day(d) AS INT) AS DayNumber,
               dayname(d) AS DayName, CAST(month(d) AS INT) AS MonthNumber, monthname(d) AS MonthName,
               CAST(quarter(d) AS INT) AS QuarterNumber, 'Q' || quarter(d) AS QuarterName,
               CAST(year(d) AS INT) AS YearNumber, strftime(d,'%Y-%b') AS MonthYear,
               CAST((dayofyear(d) - 1 + dayofweek(date_trunc('year', d))) // 7 + 1 AS INT) AS WeekNumber,
               dayofweek(d) IN (5, 6) AS IsWeekend
        FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)),
                                                 INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""",
    "FactSales": f"""
        SELECT {ORDER_KEY} AS InvoiceDateKey, l_partkey AS ProductKey, l_orderkey AS InvoiceID,
               o_custkey AS CustomerKey, o_orderpriority AS EmployeeKey, l_linestatus AS DeliveryMethodKey,
               CAST(l_quantity AS INT) AS Quantity, {UNIT_PRICE} AS UnitPrice,
               CAST(l_tax AS DECIMAL(5,2)) * 100 AS TaxRate, {LINE_TOTAL} AS LineTotal,
               {LINE_TOTAL} - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(18,2)) AS ProfitAmount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "FactPurchases": f"""
        SELECT {ORDER_KEY} AS PurchaseDateKey, {SHIP_KEY} AS ExpectedDeliveryDateKey, l_orderkey AS PurchaseOrderID,
               l_partkey AS ProductKey, l_suppkey AS SupplierKey, l_linestatus AS DeliveryMethodKey,
               CAST(l_tax AS DECIMAL(5,2)) * 100 AS TaxRate, CAST(l_quantity AS INT) AS QuantityOrdered,
               {UNIT_PRICE} AS UnitCostPrice, CAST(l_extendedprice AS DECIMAL(18,2)) AS LineCost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE {SHIP_KEY} IN (SELECT DateKey FROM DimDate)""",
    "FactInventory": """
        SELECT p_partkey AS ProductKey, CAST((p_partkey * 7) % 100 AS INT) AS CurrentStock, p_size AS ReorderLevel,
               p_size * 2 AS TargetStockLevel, CAST(p_retailprice AS DECIMAL(18,2)) AS LastCostPrice
        FROM part""",
    "FactInventoryTransactions": f"""
        SELECT {ORDER_KEY} AS DateKey, l_partkey AS ProductKey, l_orderkey AS InvoiceID,
               CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS PurchaseOrderID,
               l_returnflag AS TransactionTypeKey,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE -CAST(l_quantity AS INT) END AS Quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "FactFinancialTransactions": f"""
        SELECT {ORDER_KEY} AS DateKey, 'Customer' AS TransactionSource, o_custkey AS CustomerKey,
               CAST(NULL AS BIGINT) AS SupplierKey, o_orderkey AS InvoiceID, CAST(NULL AS BIGINT) AS PurchaseOrderID,
               o_orderpriority AS PaymentMethodKey, o_orderstatus AS TransactionTypeKey,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(23,4)) AS NetAmount,
               CAST(0 AS DECIMAL(22,4)) AS TaxAmount, CAST(o_totalprice AS DECIMAL(18,2)) AS TransactionAmount,
               CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS RemainingBalance
        FROM orders
        UNION ALL
        SELECT {SHIP_KEY}, 'Supplier', NULL, l_suppkey, NULL, l_orderkey, NULL, l_returnflag,
               CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(5,2)),
               CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(5,2)),
               CAST(l_extendedprice AS DECIMAL(18,2)),
               CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END
        FROM lineitem""",
}

# Spend at the product's last cost with tax; factors are narrowed so that the product fits a decimal.
COST_AT_LAST = (
    "CAST(fp.QuantityOrdered * dp.LastCostPrice AS DECIMAL(20,2)) "
    "* CAST(1 + fp.TaxRate * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(7,4))"
)


def over(body: str, *relations: str) -> str:
    """A statement over the named warehouse tables."""
    wanted = set(relations)
    if "FactPurchases" in wanted:
        wanted.add("DimDate")
    tables = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in RELATIONS if name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"


def money(expression: str) -> str:
    """An exact decimal sum as a double."""
    return f"CAST({expression} AS DOUBLE)"
