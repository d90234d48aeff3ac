"""Statements for past questions, forecasts and the stated measures."""

from __future__ import annotations

from oracles.dashboard import ON_CUSTOMER, ON_DATE, ON_PRODUCT, REVENUE, best_customers, best_products
from oracles.layout import COST_AT_LAST, money, over

CUSTOMER = "dc.CustomerID, dc.CustomerName"
BY_CUSTOMER = "GROUP BY dc.CustomerKey, dc.CustomerID, dc.CustomerName"
FIRST_FIVE = "ORDER BY SUM(f.LineTotal) DESC, dc.CustomerName LIMIT 5"
SALES_TABLES = ("FactSales", "DimProduct", "DimCustomer", "DimDate")
LAST_YEAR = "d.YearNumber = (SELECT MAX(YearNumber) FROM DimDate)"
TOTAL, GAIN = money("SUM(f.LineTotal)"), money("SUM(f.ProfitAmount)")
SPENT = f"{TOTAL} AS TotalRevenue, {GAIN} AS TotalProfit"
MARGIN = f"CASE WHEN SUM(f.LineTotal) = 0 THEN 0.0 ELSE {GAIN} / {TOTAL} END AS ProfitMargin"
ORDERS = "COUNT(DISTINCT f.InvoiceID)"
STOCK = "FactInventory fi JOIN DimProduct dp ON fi.ProductKey = dp.ProductKey"
LOW = "fi.CurrentStock <= fi.ReorderLevel"

QUESTION = """SELECT dc.CustomerName, CAST(SUM(fs.LineTotal) AS DOUBLE) AS TotalSales
FROM FactSales AS fs JOIN DimCustomer AS dc ON fs.CustomerKey = dc.CustomerKey
JOIN DimDate AS dd ON fs.InvoiceDateKey = dd.DateKey
WHERE dd.YearNumber = (SELECT MAX(YearNumber) FROM DimDate)
GROUP BY dc.CustomerName ORDER BY TotalSales DESC, dc.CustomerName LIMIT 5"""

SELLERS = """SELECT de.IsSalesperson, dm.DeliveryMethod, CAST(SUM(fs.LineTotal) AS DOUBLE) AS TotalSales
FROM FactSales AS fs JOIN DimEmployee AS de ON fs.EmployeeKey = de.EmployeeKey
JOIN DimDeliveryMethod AS dm ON fs.DeliveryMethodKey = dm.DeliveryMethodKey
GROUP BY de.IsSalesperson, dm.DeliveryMethod -- by who sold it"""
LISTS = """DimEmployee AS (SELECT DISTINCT o_orderpriority AS EmployeeKey, o_orderpriority <> '4-NOT SPECIFIED' AS IsSalesperson
    FROM orders),
DimDeliveryMethod AS (SELECT DISTINCT l_linestatus AS DeliveryMethodKey, l_linestatus AS DeliveryMethod FROM lineitem)"""

BY_YEAR = f"SELECT d.YearNumber, {TOTAL} AS Revenue FROM FactSales f {ON_DATE} GROUP BY d.YearNumber"

# Daily sales by product, with at least ten days; x counts days from the calendar's first day.
HISTORY = f"""WITH daily AS (
    SELECT f.ProductKey, d.FullDate AS ds, CAST(SUM(f.LineTotal) AS DECIMAL(18,4)) AS amount
    FROM FactSales f {ON_DATE} GROUP BY f.ProductKey, d.FullDate),
points AS (
    SELECT ProductKey, ds, amount, CAST(ds - (SELECT MIN(FullDate) FROM DimDate) AS INT) AS x FROM daily
    WHERE ProductKey IN (SELECT ProductKey FROM daily GROUP BY ProductKey HAVING COUNT(*) >= 10))"""
FITS = HISTORY + """,
cents AS (SELECT ProductKey, ds, x, CAST(amount AS DECIMAL(19,2)) AS c FROM points),
sums AS (
    SELECT ProductKey, CAST(COUNT(*) AS DECIMAL(8,0)) AS n, CAST(SUM(x) AS DECIMAL(12,0)) AS sx,
           CAST(SUM(CAST(x AS BIGINT) * x) AS DECIMAL(16,0)) AS sxx, CAST(SUM(c) AS DECIMAL(19,2)) AS sy,
           CAST(SUM(CAST(x AS DECIMAL(8,0)) * c) AS DECIMAL(28,2)) AS sxy,
           CAST(SUM(c * c) AS DECIMAL(30,4)) AS syy, MAX(ds) AS last_day
    FROM cents GROUP BY ProductKey),
spread AS (
    SELECT *, CAST(n * sxx - sx * sx AS DOUBLE) AS vxx, CAST(n * sxy - sx * sy AS DOUBLE) AS vxy,
           CAST(n * syy - sy * sy AS DOUBLE) AS vyy
    FROM sums),
fits AS (
    SELECT ProductKey, last_day, CAST(n AS BIGINT) AS points, vxy / vxx AS slope,
           (CAST(sy AS DOUBLE) - vxy / vxx * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept,
           sqrt(greatest(vyy - vxy * (vxy / vxx), 0.0) / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) - 2))) AS deviation
    FROM spread WHERE vxx <> 0)"""
AHEAD = FITS + """,
ahead AS (
    SELECT ProductKey, CAST(last_day + step AS DATE) AS ds, deviation,
           intercept + slope * CAST(last_day + step - (SELECT MIN(FullDate) FROM DimDate) AS INT) AS yhat
    FROM fits, (SELECT CAST(unnest(range(1, 92)) AS INT) AS step)),
forecast AS (
    SELECT ProductKey, ds, yhat, yhat - 1.2816 * deviation AS yhat_lower, yhat + 1.2816 * deviation AS yhat_upper
    FROM ahead)"""

# What the best fit of a series of days fulfils, and the days of its horizon.
BEST_FIT = """COUNT(*) AS points, COUNT(*) AS fitted, MIN(ds) AS first_day, MAX(ds) AS last_day, TRUE AS no_level_left,
    TRUE AS no_trend_left, TRUE AS no_change_left, CAST(91 AS BIGINT) AS days_ahead, CAST(MAX(ds) + 91 AS DATE) AS last_ahead,
    TRUE AS in_band"""

STATEMENTS = {
    "customers_this_year": over(
        f"""SELECT dc.CustomerName, {TOTAL} AS TotalSales FROM FactSales f {ON_CUSTOMER} {ON_DATE}
            WHERE {LAST_YEAR} GROUP BY dc.CustomerName {FIRST_FIVE}""", *SALES_TABLES),
    "customers_this_year_cte": over(
        f"""WITH CurrentYear AS (SELECT MAX(YearNumber) AS YearNumber FROM DimDate)
            SELECT {CUSTOMER}, {SPENT}, {ORDERS} AS OrderCount FROM FactSales f {ON_CUSTOMER} {ON_DATE}
            CROSS JOIN CurrentYear cy WHERE d.YearNumber = cy.YearNumber {BY_CUSTOMER} {FIRST_FIVE}""", *SALES_TABLES),
    "top_customers_by_key": over(
        f"SELECT {CUSTOMER}, {TOTAL} AS TotalRevenue FROM FactSales f {ON_CUSTOMER} {BY_CUSTOMER} {FIRST_FIVE}",
        *SALES_TABLES),
    "top_customers_by_key_lines": over(
        f"SELECT {CUSTOMER}, {SPENT}, COUNT(*) AS OrderCount FROM FactSales f {ON_CUSTOMER} {BY_CUSTOMER} {FIRST_FIVE}",
        *SALES_TABLES),
    "customer_metrics": over(
        f"""SELECT {CUSTOMER}, {SPENT}, CAST(SUM(f.Quantity) AS BIGINT) AS TotalQuantity, {ORDERS} AS OrderCount,
                   COUNT(DISTINCT f.ProductKey) AS DistinctProducts, {MARGIN},
                   {TOTAL} / CAST({ORDERS} AS DOUBLE) AS AvgOrderValue,
                   {TOTAL} / CAST(SUM(f.Quantity) AS DOUBLE) AS AvgUnitPrice
            FROM FactSales f {ON_CUSTOMER} {BY_CUSTOMER} {FIRST_FIVE}""", *SALES_TABLES),
    "customer_retention": over(
        f"""WITH best AS (
                SELECT dc.CustomerKey, {CUSTOMER}, {SPENT}, {ORDERS} AS OrderCount,
                       {TOTAL} / CAST(COUNT(*) AS DOUBLE) AS AvgOrderValue, MAX(d.FullDate) AS LastPurchaseDate
                FROM FactSales f {ON_CUSTOMER} {ON_DATE} {BY_CUSTOMER} {FIRST_FIVE}),
            categories AS (
                SELECT f.CustomerKey, dp.Category, {TOTAL} AS CategoryRevenue,
                       ROW_NUMBER() OVER (PARTITION BY f.CustomerKey
                                          ORDER BY SUM(f.LineTotal) DESC, dp.Category) AS rn
                FROM FactSales f {ON_PRODUCT} GROUP BY f.CustomerKey, dp.Category)
            SELECT best.* EXCLUDE (CustomerKey), Category AS TopCategory, CategoryRevenue AS TopCategoryRevenue
            FROM best LEFT JOIN categories ON best.CustomerKey = categories.CustomerKey AND rn = 1""", *SALES_TABLES),
    "year_vs_last": over(
        f"""WITH revenue AS ({BY_YEAR}), cy AS (SELECT MAX(YearNumber) AS y FROM DimDate)
            SELECT y AS CurrentYear, c.Revenue AS CurrentYearRevenue, CAST(y - 1 AS INT) AS LastYear,
                   l.Revenue AS LastYearRevenue
            FROM cy LEFT JOIN revenue c ON c.YearNumber = y LEFT JOIN revenue l ON l.YearNumber = y - 1""",
        *SALES_TABLES),
    "year_vs_last_rows": over(
        f"""WITH revenue AS ({BY_YEAR}), cy AS (SELECT MAX(YearNumber) AS y FROM DimDate)
            SELECT YearNumber, Revenue FROM revenue JOIN cy ON YearNumber IN (y, y - 1)""", *SALES_TABLES),
    "category_margin": over(
        f"""SELECT dp.Category, {GAIN} AS TotalProfit, {TOTAL} AS TotalRevenue, {MARGIN}
            FROM FactSales f {ON_PRODUCT} GROUP BY dp.Category""", *SALES_TABLES),
    "best_margin_category": over(
        f"""SELECT dp.Category, {MARGIN} FROM FactSales f {ON_PRODUCT} GROUP BY dp.Category
            ORDER BY ProfitMargin DESC, dp.Category LIMIT 1""", *SALES_TABLES),
    "category_profile": over(
        f"""SELECT dp.Category, {SPENT}, {MARGIN}, CAST(SUM(f.Quantity) AS BIGINT) AS TotalQuantity,
                   {money('SUM(f.UnitPrice)')} / CAST(COUNT(*) AS DOUBLE) AS AvgUnitPrice,
                   {money('SUM(f.TaxRate)')} / CAST(COUNT(*) AS DOUBLE) AS AvgTaxRate
            FROM FactSales f {ON_PRODUCT} {ON_DATE} WHERE {LAST_YEAR} GROUP BY dp.Category""", *SALES_TABLES),
    "stock_risk": over(
        f"""SELECT fi.ProductKey, dp.ProductID, dp.Product, dp.Category, fi.CurrentStock, fi.ReorderLevel,
                   fi.TargetStockLevel FROM {STOCK} WHERE {LOW}""", "FactInventory", "DimProduct"),
    "example_top_customers": best_customers(5),
    "example_top_products": best_products(10, f"{REVENUE} AS revenue"),
    "example_reorder": over(
        f"SELECT dp.Product, fi.CurrentStock, fi.ReorderLevel FROM {STOCK} WHERE {LOW}", "FactInventory",
        "DimProduct"),
    "example_supplier_spend": over(
        f"""SELECT ds.SupplierName AS supplier, {money('SUM(f.LineCost)')} AS total_spend
            FROM FactPurchases f JOIN DimSupplier ds ON f.SupplierKey = ds.SupplierKey
            JOIN DimDate d ON f.PurchaseDateKey = d.DateKey WHERE {LAST_YEAR}
            GROUP BY ds.SupplierName ORDER BY SUM(f.LineCost) DESC, supplier LIMIT 10""",
        "FactPurchases", "DimSupplier", "DimDate"),
    "example_monthly_trend": over(
        f"""SELECT d.MonthName || ' ' || d.YearNumber AS period, {TOTAL} AS revenue FROM FactSales f {ON_DATE}
            GROUP BY d.YearNumber, d.MonthNumber, d.MonthName""", *SALES_TABLES),
    "example_category_sales": over(
        f"SELECT dp.Category, {TOTAL} AS revenue FROM FactSales f {ON_PRODUCT} GROUP BY dp.Category", *SALES_TABLES),
    "adhoc_sql": over(QUESTION, *SALES_TABLES),
    "adhoc_sql_lists": over(f"WITH {LISTS} {SELLERS}", "FactSales"),
    "daily_history": over(
        f"SELECT d.FullDate AS ds, {TOTAL} AS y FROM FactSales f {ON_DATE} GROUP BY d.FullDate", *SALES_TABLES),
    "daily_history_product": over(
        f"""SELECT d.FullDate AS ds, {TOTAL} AS y FROM FactSales f {ON_DATE} WHERE f.ProductKey = 7
            GROUP BY d.FullDate""", *SALES_TABLES),
    "daily_histories": over(HISTORY + " SELECT ProductKey, ds, CAST(amount AS DOUBLE) AS y FROM points", *SALES_TABLES),
    "linear_trend": over(
        FITS + " SELECT ProductKey, points, ROUND(slope, 6) AS slope, ROUND(intercept, 6) AS intercept FROM fits",
        *SALES_TABLES),
    "linear_forecast": over(AHEAD + " SELECT * FROM forecast", *SALES_TABLES),
    "forecast_summary": over(
        AHEAD + """,
        recent AS (
            SELECT ProductKey, CAST(SUM(amount) AS DOUBLE) AS recent
            FROM points JOIN (SELECT ProductKey, MAX(ds) AS last_day FROM points GROUP BY ProductKey) USING (ProductKey)
            WHERE ds > last_day - 91 GROUP BY ProductKey),
        totals AS (
            SELECT ProductKey, SUM(greatest(yhat, 0.0)) AS ahead, SUM(greatest(yhat_lower, 0.0)) AS low,
                   SUM(greatest(yhat_upper, 0.0)) AS high FROM forecast GROUP BY ProductKey),
        changes AS (
            SELECT ProductKey, CAST(printf('%.2f', recent) AS DOUBLE) AS recent_actual,
                   CAST(printf('%.2f', ahead) AS DOUBLE) AS forecast_total, CAST(printf('%.2f', low) AS DOUBLE) AS low_total,
                   CAST(printf('%.2f', high) AS DOUBLE) AS high_total,
                   CASE WHEN recent > 0 THEN CAST(printf('%.1f', (ahead - recent) / recent * 100) AS DOUBLE) END AS pct_change
            FROM recent JOIN totals USING (ProductKey))
        SELECT *, CASE WHEN COALESCE(pct_change, 0) > 5 THEN 'up' WHEN COALESCE(pct_change, 0) < -5 THEN 'down'
                       ELSE 'flat' END AS trend, COALESCE(abs(pct_change) > 100, FALSE) AS implausible_growth
        FROM changes""", *SALES_TABLES),
    "forecast_fit": over(
        HISTORY + f""" SELECT ProductKey, {BEST_FIT} FROM points GROUP BY ProductKey""", *SALES_TABLES),
    "forecast_all_fit": over(
        f"""WITH points AS (SELECT d.FullDate AS ds FROM FactSales f {ON_DATE} GROUP BY d.FullDate)
            SELECT {BEST_FIT} FROM points HAVING COUNT(*) >= 10""", *SALES_TABLES),
    "actual_vs_forecast": over(
        AHEAD + """
        SELECT COALESCE(p.ProductKey, f.ProductKey) AS ProductKey, COALESCE(p.ds, f.ds) AS ds,
               CAST(amount AS DOUBLE) AS actual, yhat, yhat_lower, yhat_upper
        FROM points p FULL JOIN forecast f ON p.ProductKey = f.ProductKey AND p.ds = f.ds""", *SALES_TABLES),
    "average_order_value": over(
        f"""SELECT d.YearNumber, d.MonthNumber, {ORDERS} AS orders,
                   {TOTAL} / CAST({ORDERS} AS DOUBLE) AS average_order_value
            FROM FactSales f {ON_DATE} GROUP BY d.YearNumber, d.MonthNumber""", *SALES_TABLES),
    "inventory_turnover": over(
        """WITH sold AS (SELECT ProductKey, SUM(Quantity) AS q FROM FactSales GROUP BY ProductKey),
           totals AS (
               SELECT dp.Category, SUM(CAST(COALESCE(q, 0) AS BIGINT) * fi.LastCostPrice) AS s,
                      SUM(fi.CurrentStock * fi.LastCostPrice) AS h
               FROM FactInventory fi JOIN DimProduct dp ON fi.ProductKey = dp.ProductKey
               LEFT JOIN sold ON sold.ProductKey = fi.ProductKey GROUP BY dp.Category)
           SELECT Category, CAST(s AS DOUBLE) AS cost_of_sales, CAST(h AS DOUBLE) AS stock_value,
                  CAST(s AS DOUBLE) / NULLIF(CAST(h AS DOUBLE), 0) AS turnover FROM totals""",
        "FactSales", "FactInventory", "DimProduct"),
    "stock_by_day": over(
        """WITH daily AS (SELECT ProductKey, DateKey, SUM(Quantity) AS moved FROM FactInventoryTransactions GROUP BY ALL),
           running AS (
               SELECT *, SUM(moved) OVER (PARTITION BY ProductKey)
                         - SUM(moved) OVER (PARTITION BY ProductKey ORDER BY DateKey) AS later FROM daily)
           SELECT r.ProductKey, strptime(CAST(DateKey AS VARCHAR), '%Y%m%d')::DATE AS FullDate, CAST(moved AS BIGINT) AS moved,
                  CAST(CurrentStock - later AS BIGINT) AS balance
           FROM running r JOIN FactInventory i ON r.ProductKey = i.ProductKey WHERE DateKey // 10000 = 1998""",
        "FactInventoryTransactions", "FactInventory"),
    "inventory_turnover_of": over(
        """WITH daily AS (SELECT ProductKey, DateKey, SUM(Quantity) AS moved FROM FactInventoryTransactions GROUP BY ALL),
           days AS (SELECT DateKey FROM DimDate WHERE DateKey >= 19980101),
           grid AS (
               SELECT i.ProductKey, i.LastCostPrice, days.DateKey, i.CurrentStock,
                      SUM(COALESCE(moved, 0)) OVER (PARTITION BY i.ProductKey)
                      - SUM(COALESCE(moved, 0)) OVER (PARTITION BY i.ProductKey ORDER BY days.DateKey) AS later
               FROM FactInventory i CROSS JOIN days LEFT JOIN daily d ON d.ProductKey = i.ProductKey AND d.DateKey = days.DateKey),
           held AS (SELECT ProductKey, SUM((CurrentStock - later) * LastCostPrice) AS h FROM grid
                    WHERE DateKey // 10000 = 1998 GROUP BY ProductKey),
           sold AS (SELECT ProductKey, SUM(Quantity) AS q FROM FactSales WHERE InvoiceDateKey // 10000 = 1998 GROUP BY ProductKey),
           totals AS (
               SELECT p.Category, CAST(SUM(COALESCE(q, 0) * p.LastCostPrice) AS DOUBLE) AS s, CAST(SUM(h) AS DOUBLE) / 365 AS a
               FROM held JOIN DimProduct p ON held.ProductKey = p.ProductKey LEFT JOIN sold ON sold.ProductKey = held.ProductKey
               GROUP BY p.Category)
           SELECT Category, s AS cost_of_sales, a AS average_stock_value, s / NULLIF(a, 0) AS turnover FROM totals""",
        "FactInventoryTransactions", "FactInventory", "FactSales", "DimDate", "DimProduct"),
    "supplier_fulfilment": over(
        """WITH leads AS (
               SELECT SupplierKey, strptime(CAST(ExpectedDeliveryDateKey AS VARCHAR), '%Y%m%d')::DATE
                                   - strptime(CAST(PurchaseDateKey AS VARCHAR), '%Y%m%d')::DATE AS lead FROM FactPurchases)
           SELECT SupplierKey, COUNT(*) AS line_count, SUM(lead) / CAST(COUNT(*) AS DOUBLE) AS lead_days,
                  COUNT(*) FILTER (WHERE lead <= 60) / CAST(COUNT(*) AS DOUBLE) AS share_in_time
           FROM leads GROUP BY SupplierKey""", "FactPurchases"),
    "supplier_concentration": over(
        f"""WITH spend AS (SELECT fp.SupplierKey, SUM({COST_AT_LAST}) AS s
                          FROM FactPurchases fp JOIN DimProduct dp ON fp.ProductKey = dp.ProductKey GROUP BY fp.SupplierKey),
            ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY s DESC, SupplierKey) AS rank,
                              SUM(s) OVER (ORDER BY s DESC, SupplierKey ROWS UNBOUNDED PRECEDING) AS upto,
                              CAST((SELECT SUM(s) FROM spend) AS DOUBLE) AS everything,
                              (SELECT SUM(CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) FROM spend) AS squares FROM spend)
            SELECT CAST(rank AS INT) AS rank, SupplierKey, CAST(s AS DOUBLE) AS spend, CAST(s AS DOUBLE) / everything AS spend_share,
                   CAST(upto AS DOUBLE) / everything AS cumulative_share,
                   ROUND(squares / (everything * everything), 9) AS concentration
            FROM ranked WHERE rank <= 20""", "FactPurchases", "DimProduct"),
    "customer_growth": over(
        f"""WITH months AS (SELECT DISTINCT f.CustomerKey, d.YearNumber, d.MonthNumber FROM FactSales f {ON_DATE}),
            firsts AS (SELECT CustomerKey, MIN(YearNumber * 12 + MonthNumber) AS m FROM months GROUP BY CustomerKey)
            SELECT YearNumber, MonthNumber,
                   COUNT(*) FILTER (WHERE YearNumber * 12 + MonthNumber = m) AS new_customers,
                   COUNT(*) FILTER (WHERE YearNumber * 12 + MonthNumber <> m) AS returning_customers
            FROM months JOIN firsts USING (CustomerKey) GROUP BY YearNumber, MonthNumber""", *SALES_TABLES),
    "supplier_performance": over(
        f"""WITH spend AS (
                SELECT fp.SupplierKey, ds.SupplierName, SUM({COST_AT_LAST}) AS s, COUNT(*) AS line_count
                FROM FactPurchases fp JOIN DimSupplier ds ON fp.SupplierKey = ds.SupplierKey
                JOIN DimProduct dp ON fp.ProductKey = dp.ProductKey GROUP BY fp.SupplierKey, ds.SupplierName)
            SELECT SupplierKey, SupplierName, CAST(s AS DOUBLE) AS spend, line_count,
                   CAST(s AS DOUBLE) / CAST((SELECT SUM(s) FROM spend) AS DOUBLE) AS spend_share FROM spend""",
        "FactPurchases", "DimSupplier", "DimProduct"),
    "inventory_health": over(
        """SELECT ProductKey, CurrentStock, ReorderLevel, TargetStockLevel,
                  CAST(CurrentStock AS DOUBLE) / NULLIF(CAST(ReorderLevel AS DOUBLE), 0) AS stock_ratio,
                  CASE WHEN CurrentStock <= ReorderLevel THEN 'low' WHEN CurrentStock > TargetStockLevel THEN 'over'
                       ELSE 'ok' END AS health FROM FactInventory""", "FactInventory"),
}
