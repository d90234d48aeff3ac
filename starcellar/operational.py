"""The given tables as the operational tables a load reads.

Lists of names (categories, methods, types) are the distinct values of a column; their ids are the names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.layout import Tables
from starcellar.operators import dimensions
from starcellar.operators.lookup import short_list
from starcellar.schemas import Rules


class Operational:
    def __init__(self, tables: Tables):
        self.tables = tables

    def _names(self, table: str, column: str, entity: str) -> DataFrame:
        """A two-column list from a column's values; combined map-side, whatever the table's size."""
        values = self.tables.read(table).select(F.col(column).alias(f"{entity}ID")).distinct()
        return values.filter(F.col(f"{entity}ID").isNotNull()).withColumn(f"{entity}Name", F.col(f"{entity}ID"))

    # Places and people ---------------------------------------------------------------------------

    def countries(self) -> DataFrame:
        return self.tables.read("region").select(
            F.col("r_regionkey").alias("CountryID"), F.col("r_name").alias("CountryName"),
            F.col("r_name").alias("Continent"),
        )

    def states(self) -> DataFrame:
        return self.tables.read("region").select(
            F.col("r_regionkey").alias("StateProvinceID"), F.col("r_name").alias("StateProvinceName"),
            F.col("r_regionkey").alias("CountryID"),
        )

    def cities(self) -> DataFrame:
        return self.tables.read("nation").select(
            F.col("n_nationkey").alias("CityID"), F.col("n_name").alias("CityName"),
            F.col("n_regionkey").alias("StateProvinceID"),
        )

    def people(self) -> DataFrame:
        """Employees and customers, as one list of people."""
        employees = self._names("orders", "o_orderpriority", "Person").select(
            F.col("PersonName").alias("FullName"), F.lit(1).alias("IsEmployee"),
            (F.col("PersonName") != "4-NOT SPECIFIED").alias("IsSalesperson"),
        )
        customers = self.tables.read("customer").select(
            F.col("c_name").alias("FullName"), F.lit(0).alias("IsEmployee"), F.lit(False).alias("IsSalesperson")
        )
        return employees.unionByName(customers).select(F.col("FullName").alias("PersonID"), "*")

    def customers(self) -> DataFrame:
        return self.tables.read("customer").select(
            F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("CustomerName"),
            F.col("c_mktsegment").alias("CustomerCategoryID"), F.lit(None).cast("string").alias("BuyingGroupID"),
            F.col("c_nationkey").alias("CityID"),
        )

    def customer_categories(self) -> DataFrame:
        return self._names("customer", "c_mktsegment", "CustomerCategory")

    def buying_groups(self) -> DataFrame:
        """No group is given, so the list is empty."""
        return self.customers().select(
            "BuyingGroupID", F.col("BuyingGroupID").alias("BuyingGroupName")
        ).filter("BuyingGroupID IS NOT NULL").distinct()

    def suppliers(self) -> DataFrame:
        return self.tables.suppliers().select(
            F.col("SupplierID"), "SupplierName", F.col("SupplierCategory").alias("SupplierCategoryID"),
            F.col("LocationKey").alias("CityID"),
        )

    def supplier_categories(self) -> DataFrame:
        return self.suppliers().select(
            "SupplierCategoryID", F.col("SupplierCategoryID").alias("SupplierCategoryName")
        ).distinct()

    # Products ------------------------------------------------------------------------------------

    def products(self) -> DataFrame:
        return self.tables.products().select(
            "ProductID", F.col("Product").alias("ProductName"), F.col("Category").alias("CategoryID"),
            F.col("Color").alias("ColorID"), "Brand",
        )

    def categories(self) -> DataFrame:
        return self._names("part", "p_type", "Category")

    def colors(self) -> DataFrame:
        colors = self.tables.products().select(F.col("Color").alias("ColorID")).filter("ColorID IS NOT NULL")
        return colors.distinct().withColumn("ColorName", F.col("ColorID"))

    def inventory(self) -> DataFrame:
        return self.tables.stock().withColumnRenamed("ProductKey", "ProductID")

    def delivery_methods(self) -> DataFrame:
        return self._names("lineitem", "l_linestatus", "DeliveryMethod")

    def payment_methods(self) -> DataFrame:
        return self._names("orders", "o_orderpriority", "PaymentMethod")

    def transaction_types(self) -> DataFrame:
        """Types of stock movements and of customer payments."""
        both = self._names("lineitem", "l_returnflag", "TransactionType").unionByName(
            self._names("orders", "o_orderstatus", "TransactionType")
        )
        return both.distinct()

    # Documents -----------------------------------------------------------------------------------

    def invoices(self) -> DataFrame:
        return self.tables.order_heads().select(
            F.col("OrderKey").alias("InvoiceID"), F.col("OrderKey").alias("OrderID"),
            F.col("CustomerKey").alias("CustomerID"), F.col("EmployeeKey").alias("EmployeeID"),
            F.col("OrderDate").alias("InvoiceDate"),
        )

    def priced_lines(self) -> DataFrame:
        """Order lines as extracted: quantity and unit price, amounts still to be computed."""
        return self.tables.order_lines().select(
            F.col("OrderKey").alias("OrderID"), F.col("ProductKey").alias("StockItemID"), "Quantity", "UnitPrice",
            "TaxRate",
        )

    def costs(self) -> DataFrame:
        return self.tables.stock().select(F.col("ProductKey").alias("StockItemID"), "LastCostPrice")

    def invoice_details(
        self, invoices: DataFrame | None = None, also: tuple[str, ...] = (), heads: DataFrame | None = None
    ) -> DataFrame:
        """Invoice lines with their profit, NULL without a known cost; the delivery method is given per line here.

        With ``invoices`` only their lines, before anything else is joined to them.  ``also``: given columns, or
        ``LineID``, carried along.  With ``heads`` the lines of these invoices with all their columns: lines meet them
        first, so they are shuffled once by invoice and once by product.
        """
        costs = self.tables.products().select("ProductKey", "LastCostPrice")
        lines = self.tables.order_lines(also)
        if invoices is not None:
            lines = lines.join(invoices.select(F.col("InvoiceID").alias("OrderKey")), "OrderKey", "left_semi")
        if heads is not None:
            lines = lines.join(heads.withColumnRenamed("InvoiceID", "OrderKey"), "OrderKey")
            also = (*also, *(c for c in heads.columns if c != "InvoiceID"))
        lines = lines.join(costs, "ProductKey", "left")
        return lines.select(
            F.col("OrderKey").alias("InvoiceID"), F.col("ProductKey").alias("ProductID"),
            F.col("DeliveryMethodKey").alias("DeliveryMethodID"), "Quantity", "UnitPrice", "TaxRate", "LineTotal",
            (F.col("LineTotal") - F.col("Quantity") * F.col("LastCostPrice")).alias("ProfitAmount"), *also,
        )

    def purchase_orders(self) -> DataFrame:
        return self.tables.order_heads().select(
            F.col("OrderKey").alias("PurchaseOrderID"), F.col("OrderDate").alias("PurchaseOrderDate")
        )

    def purchase_details(self) -> DataFrame:
        """Purchase order lines; supplier, delivery and expected date are given per line here."""
        return self.tables.order_lines().select(
            F.col("OrderKey").alias("PurchaseOrderID"), F.col("ProductKey").alias("ProductID"),
            F.col("SupplierKey").alias("SupplierID"), F.col("DeliveryMethodKey").alias("DeliveryMethodID"),
            F.col("l_shipdate").cast("date").alias("ExpectedDeliveryDate"),
            F.col("Quantity").alias("QuantityOrdered"), F.col("UnitPrice").alias("UnitCostPrice"), "TaxRate",
            F.col("ListAmount").alias("LineCost"),
        )

    def inventory_transactions(self) -> DataFrame:
        """Stock movements at the time of the order: returned lines come in, the others go out."""
        returned = F.col("TransactionTypeKey") == "R"
        lines = self.tables.order_lines().select(
            F.col("OrderKey").alias("InvoiceID"), F.col("ProductKey").alias("ProductID"),
            F.col("TransactionTypeKey").alias("TransactionTypeID"),
            F.when(returned, F.col("OrderKey")).alias("PurchaseOrderID"),
            F.when(returned, F.col("Quantity")).otherwise(-F.col("Quantity")).alias("Quantity"),
        )
        times = self.tables.read("orders").select(
            F.col("o_orderkey").alias("InvoiceID"), F.col("o_orderdate").alias("TransactionDate")
        )
        return lines.join(times, "InvoiceID")

    # Dimensions ----------------------------------------------------------------------------------

    def dim_date(self) -> DataFrame:
        return dimensions.dim_date([(self.tables.read("orders"), ["o_orderdate"])])

    def dim_location(self) -> DataFrame:
        return dimensions.dim_location(self.cities(), self.states(), self.countries())

    def keyed_locations(self) -> DataFrame:
        return dimensions.with_natural_key(self.dim_location(), "CityID", "LocationKey")

    def dim_customer(self) -> DataFrame:
        return dimensions.dim_customer(
            self.customers(), short_list(self.customer_categories()), short_list(self.buying_groups()),
            self.keyed_locations(),
        )

    def dim_supplier(self) -> DataFrame:
        return dimensions.dim_supplier(
            self.suppliers(), short_list(self.supplier_categories()), self.keyed_locations()
        )

    def dim_product(self) -> DataFrame:
        return dimensions.dim_product(
            self.products(), short_list(self.categories()), short_list(self.colors()), self.inventory()
        )

    def employees(self) -> DataFrame:
        return self._names("orders", "o_orderpriority", "Employee")

    def salespeople(self) -> DataFrame:
        """Employees with whether they sell."""
        return self.employees().select(
            "EmployeeID", F.col("EmployeeName").alias("FullName"),
            (F.col("EmployeeName") != "4-NOT SPECIFIED").alias("IsSalesperson"),
        )

    def dims(self) -> Dims:
        """The dimensions a load looks keys up in, natural keys in place of surrogate keys."""

        def keyed(rows: DataFrame, natural: str, key: str) -> DataFrame:
            return dimensions.with_natural_key(rows.select(natural), natural, key)

        def listed(rows: DataFrame, entity: str) -> DataFrame:
            return short_list(keyed(rows, f"{entity}ID", f"{entity}Key"))

        return Dims({
            "DimDate": lambda: self.dim_date().select("DateKey", "FullDate"),
            "DimProduct": lambda: keyed(self.products(), "ProductID", "ProductKey"),
            "DimCustomer": lambda: keyed(self.customers(), "CustomerID", "CustomerKey"),
            "DimSupplier": lambda: keyed(self.suppliers(), "SupplierID", "SupplierKey"),
            "DimEmployee": lambda: listed(self.employees(), "Employee"),
            "DimDeliveryMethod": lambda: listed(self.delivery_methods(), "DeliveryMethod"),
            "DimTransactionType": lambda: listed(self.transaction_types(), "TransactionType"),
            "DimPaymentMethod": lambda: listed(self.payment_methods(), "PaymentMethod"),
        })


class Dims(Mapping):
    """Dimensions by name, each made when a load first asks for it."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# Rules the given tables are checked against.  The data breaks some of them: its lines have no unique
# number, and some balances are negative.
GIVEN_RULES: dict[str, Rules] = {
    "region": Rules("r_regionkey", ("r_name",), lengths={"r_name": 100}),
    "nation": Rules("n_nationkey", ("n_name", "n_regionkey"), {"n_regionkey": ("region", "r_regionkey")}),
    "customer": Rules(
        "c_custkey", ("c_name", "c_mktsegment", "c_nationkey"), {"c_nationkey": ("nation", "n_nationkey")},
        {"balance_not_negative": "c_acctbal >= 0"}, {"c_name": 100, "c_mktsegment": 8},
    ),
    "supplier": Rules(
        "s_suppkey", ("s_name", "s_nationkey"), {"s_nationkey": ("nation", "n_nationkey")}, lengths={"s_name": 100}
    ),
    "part": Rules("p_partkey", ("p_name", "p_type"), checks={"size_at_most_40": "p_size <= 40"},
                  lengths={"p_name": 150, "p_brand": 100}),
    "orders": Rules(
        "o_orderkey", ("o_custkey", "o_orderdate", "o_orderpriority"), {"o_custkey": ("customer", "c_custkey")}
    ),
    "lineitem": Rules(
        ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_quantity"),
        {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"),
         "l_suppkey": ("supplier", "s_suppkey")},
        {"quantity_positive": "l_quantity > 0"},
    ),
}
