"""Schemas used by the tests, as specs."""

from rowsmith.functions.checks import between, cmp, col
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, ENUM, INT, TEXT, VARCHAR, Column, DatasetSpec, ForeignKey, Table


def pk(name):
    return Column(name, INT)


def ref(name, parent, target=None, nullable=False):
    return Column(name, INT, nullable=nullable), ForeignKey((name,), parent, (target or name,))


def text(name, size=255, required=False, **more):
    return Column(name, VARCHAR(size), nullable=not required, **more)


def table(name, key, *items, checks=()):
    columns, keys = [pk(key)], []
    for item in items:
        if isinstance(item, tuple):
            columns.append(item[0])
            keys.append(item[1])
        else:
            columns.append(item)
    return Table(name, tuple(columns), (key,), foreign_keys=tuple(keys), checks=tuple(checks))


def enum(name, *values, required=False, default=None):
    return Column(name, ENUM(*values), nullable=not required, default=default)


RATING = Column("rating", INT, nullable=False, checks=(between(col("rating"), 1, 5),))

COMPANY = DatasetSpec(
    (
        table("Companies", "company_id", text("name", required=True), text("address", required=True), text("city", 100, True), text("state", 50, True), text("zip_code", 10), text("phone_number", 20), text("industry", 100), text("website")),
        table("Departments", "department_id", ref("company_id", "Companies"), text("name", 100, True), text("location"), Column("manager_id", INT)),
        table(
            "Employees",
            "employee_id",
            text("first_name", 100, True),
            text("last_name", 100, True),
            text("middle_name", 100),
            text("email", required=True, unique=True),
            text("phone_number", 20),
            Column("hire_date", DATE, nullable=False),
            text("job_title", 100, True),
            ref("department_id", "Departments"),
            Column("salary", DECIMAL(10, 2), nullable=False),
            enum("employment_status", "Full-time", "Part-time", "Contract", "Temporary", required=True),
        ),
        table(
            "Projects",
            "project_id",
            text("name", required=True),
            Column("description", TEXT),
            Column("start_date", DATE, nullable=False),
            Column("end_date", DATE),
            ref("company_id", "Companies"),
            enum("project_status", "Planning", "In Progress", "Completed", "On Hold", "Cancelled", required=True),
            Column("budget", DECIMAL(12, 2)),
        ),
        table(
            "Employee_Projects",
            "employee_project_id",
            ref("employee_id", "Employees"),
            ref("project_id", "Projects"),
            text("role", 100),
            Column("hours_worked", DECIMAL(8, 2)),
            Column("start_date", DATE),
            Column("end_date", DATE),
        ),
        table("Employee_Benefits", "benefit_id", ref("employee_id", "Employees"), text("benefit_type", 100, True), Column("enrollment_date", DATE, nullable=False), Column("coverage_amount", DECIMAL(10, 2))),
        table(
            "Performance_Reviews",
            "review_id",
            ref("employee_id", "Employees"),
            ref("reviewer_id", "Employees", "employee_id"),
            Column("review_date", DATE, nullable=False),
            RATING,
            Column("comments", TEXT),
            Column("goals_set", TEXT),
            enum("review_status", "Draft", "Final", "Approved", default="'Draft'"),
        ),
    )
)

RESTAURANTS = DatasetSpec(
    (
        table(
            "Restaurants",
            "restaurant_id",
            text("name", required=True),
            text("address", required=True),
            text("city", 100, True),
            text("state", 50, True),
            text("zip_code", 10),
            text("phone_number", 20),
            enum("cuisine_type", "Italian", "Mexican", "American", "Chinese", "Indian", "Other", required=True),
            text("opening_hours"),
            Column("rating", DECIMAL(3, 2)),
        ),
        table(
            "Customers",
            "customer_id",
            text("first_name", 100, True),
            text("last_name", 100, True),
            text("email", required=True, unique=True),
            text("phone_number", 20),
            text("address"),
            text("city", 100),
            text("state", 50),
            text("zip_code", 10),
            Column("registration_date", DATETIME, default="CURRENT_TIMESTAMP"),
        ),
        table(
            "Orders",
            "order_id",
            ref("customer_id", "Customers"),
            ref("restaurant_id", "Restaurants"),
            Column("order_date", DATETIME, default="CURRENT_TIMESTAMP"),
            Column("total_amount", DECIMAL(10, 2), nullable=False),
            enum("payment_method", "Credit Card", "Cash", "Online Payment", "Gift Card", required=True),
            enum("order_status", "Pending", "Processing", "Shipped", "Delivered", "Cancelled", "Refunded", default="'Pending'"),
            text("delivery_address"),
        ),
        table(
            "Menu",
            "menu_id",
            ref("restaurant_id", "Restaurants"),
            text("item_name", required=True),
            Column("description", TEXT),
            Column("price", DECIMAL(10, 2), nullable=False),
            enum("category", "Appetizer", "Main Course", "Dessert", "Beverage", "Special", required=True),
            Column("available", BOOLEAN, default="TRUE"),
        ),
        table(
            "Order_Items",
            "order_item_id",
            ref("order_id", "Orders"),
            ref("menu_id", "Menu"),
            Column("quantity", INT, nullable=False),
            Column("subtotal", DECIMAL(10, 2), nullable=False),
            Column("special_instructions", TEXT),
        ),
        table("Reviews", "review_id", ref("restaurant_id", "Restaurants"), ref("customer_id", "Customers"), RATING, Column("review_text", TEXT), Column("review_date", DATETIME, default="CURRENT_TIMESTAMP")),
        table(
            "Delivery_Drivers",
            "driver_id",
            text("first_name", 100, True),
            text("last_name", 100, True),
            enum("vehicle_type", "Car", "Motorcycle", "Bicycle", required=True),
            text("license_number", 20, True, unique=True),
            text("phone_number", 20),
            enum("availability_status", "Available", "Busy", "Unavailable", default="'Available'"),
            Column("join_date", DATE),
            Column("termination_date", DATE),
        ),
    )
)

LIBRARY = DatasetSpec(
    (
        table("Authors", "author_id", text("first_name", 100, True), text("last_name", 100, True), Column("birth_date", DATE), Column("death_date", DATE), text("nationality", 100), Column("biography", TEXT)),
        table("Publishers", "publisher_id", text("name", required=True), text("address"), text("city", 100), text("state", 50), text("zip_code", 10), text("country", 100), text("contact_email"), text("contact_phone", 20)),
        table(
            "Books",
            "book_id",
            text("title", required=True),
            ref("author_id", "Authors"),
            ref("publisher_id", "Publishers"),
            text("isbn", 20, True, unique=True),
            Column("publication_date", DATE),
            text("genre", 100),
            text("edition", 50),
            Column("number_of_pages", INT),
            text("language", 50),
            enum("format", "Hardcover", "Paperback", "E-book", "Audiobook"),
        ),
        table("Library_Branches", "branch_id", text("name", required=True), text("address", required=True), text("city", 100, True), text("state", 50, True), text("zip_code", 10), text("phone_number", 20), ref("manager_id", "Employees", "employee_id", nullable=True), text("opening_hours")),
        table(
            "Library_Members",
            "member_id",
            text("first_name", 100, True),
            text("last_name", 100, True),
            Column("date_of_birth", DATE),
            enum("gender", "Male", "Female", "Other"),
            text("email", required=True, unique=True),
            text("phone_number", 20),
            Column("join_date", DATE, nullable=False),
            enum("membership_type", "Regular", "Premium", "Student", "Senior"),
            enum("account_status", "Active", "Inactive", "Suspended", "Closed", default="'Active'"),
        ),
        table("Book_Inventory", "inventory_id", ref("book_id", "Books"), ref("branch_id", "Library_Branches"), Column("quantity", INT, nullable=False), Column("available_quantity", INT, nullable=False), enum("condition", "New", "Good", "Fair", "Poor")),
        table(
            "Book_Loans",
            "loan_id",
            ref("member_id", "Library_Members"),
            ref("inventory_id", "Book_Inventory"),
            Column("loan_date", DATETIME, nullable=False),
            Column("due_date", DATE, nullable=False),
            Column("return_date", DATETIME),
            enum("loan_status", "Checked Out", "Returned", "Overdue", "Lost", "Renewed", default="'Checked Out'"),
            Column("fine_amount", DECIMAL(10, 2), default="0"),
        ),
        table("Employees", "employee_id", text("first_name", 100, True), text("last_name", 100, True), text("job_title", 100), ref("department_id", "Departments", nullable=True), ref("branch_id", "Library_Branches", nullable=True), text("email"), text("phone_number", 20), Column("hire_date", DATE)),
        table("Departments", "department_id", text("name", 100), text("location"), ref("manager_id", "Employees", "employee_id", nullable=True)),
    )
)

CUSTOMERS = Table(
    "Customers",
    (
        pk("customer_id"),
        Column("email", VARCHAR(30), nullable=False, unique=True),
        Column("nickname", VARCHAR(10)),
        Column("tier", ENUM("basic", "gold"), nullable=False),
        Column("balance", DECIMAL(5, 2)),
        Column("joined_on", DATE),
        Column("created_at", DATETIME, default="CURRENT_TIMESTAMP"),
        Column("active", BOOLEAN, default="TRUE"),
    ),
    ("customer_id",),
)
REVIEWS = Table(
    "Reviews",
    (pk("review_id"), Column("customer_id", INT), Column("rating", INT, nullable=False, checks=(cmp(col("rating"), ">=", 1), cmp(col("rating"), "<=", 5)))),
    ("review_id",),
    foreign_keys=(ForeignKey(("customer_id",), "Customers", ("customer_id",)),),
)
MAIN = DatasetSpec((CUSTOMERS, REVIEWS))
