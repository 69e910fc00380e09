"""The small demonstration school used by the golden tests, as literal rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyslot import schema
from tallyslot.sources.dataset import Dataset, conform

# --- fixed values: the demonstration rows ------------------------------------
STAFF = """
(1, 'Dave', 'David', 'Thompson', '1980-04-12', '2015-01-10 09:00:00', NULL, 'Licensed driving instructor, manual + automatic', 'ACT'),
(2, 'Sue', 'Susan', 'Patel', '1985-09-23', '2017-03-01 09:00:00', NULL, 'Licensed instructor, automatic specialist', 'ACT'),
(3, 'Mike', 'Michael', 'OBrien', '1978-12-02', '2013-06-15 09:00:00', NULL, 'Licensed instructor, manual', 'ACT'),
(4, 'Anya', 'Anya', 'Kowalski', '1990-07-30', '2020-09-01 09:00:00', NULL, 'Licensed instructor, manual', 'ACT'),
(5, 'Tom', 'Thomas', 'Edwards', '1975-02-17', '2012-02-20 09:00:00', '2023-11-30 17:00:00', 'Retired instructor', 'INA'),
(6, NULL, 'Grace', 'Lawson', '1992-11-05', '2021-04-12 09:00:00', NULL, 'Office administrator - not an instructor', 'ACT')
"""
CUSTOMERS = """
(1, 2, 'ACT', '2024-01-15', '2006-05-20', 'James', 'Wright'),
(2, 3, 'ACT', '2024-02-02', '2005-08-11', 'Sophie', 'Clarke'),
(3, 5, 'ACT', '2024-02-20', '2007-01-30', 'Liam', 'Murphy'),
(4, 7, 'ACT', '2024-03-05', '2004-12-09', 'Aisha', 'Khan'),
(5, 8, 'SUS', '2023-11-10', '2003-03-17', 'Daniel', 'Evans'),
(6, 10, 'ACT', '2024-04-01', '2006-09-25', 'Chloe', 'Roberts'),
(7, 1, 'PASS', '2023-09-12', '2002-06-14', 'Oliver', 'Bennett'),
(8, 4, 'ACT', '2024-05-18', '2008-02-28', 'Maya', 'Singh')
"""
LESSONS = """
(1, 1, 'COMP', 1, 1, '2024-06-03', 9, 65), (2, 1, 'COMP', 1, 1, '2024-06-10', 9, 70), (3, 1, 'BOOK', 1, 1, '2026-06-15', 9, 80),
(4, 2, 'COMP', 2, 4, '2024-06-05', 11, 75), (5, 2, 'CONF', 2, 4, '2026-06-12', 11, 75), (6, 3, 'COMP', 3, 2, '2024-06-07', 14, 70),
(7, 3, 'CANC', 3, 2, '2024-06-14', 14, 70), (8, 4, 'COMP', 4, 3, '2024-06-08', 10, 70), (9, 4, 'BOOK', 4, 3, '2026-06-16', 10, 70),
(10, 5, 'NOSH', 1, 1, '2024-06-09', 16, 70), (11, 6, 'COMP', 2, 5, '2024-06-11', 13, 75), (12, 6, 'BOOK', 2, 5, '2026-06-18', 13, 75),
(13, 7, 'COMP', 1, 1, '2024-05-20', 9, 65), (14, 8, 'COMP', 3, 6, '2024-06-02', 15, 70)
"""
PAYMENTS = """
(1, '2024-06-03 09:45:00', 'CARD', 65), (1, '2024-06-10 09:45:00', 'CARD', 70), (2, '2024-06-05 11:45:00', 'CASH', 75),
(3, '2024-06-07 14:45:00', 'BANK', 70), (4, '2024-06-08 10:45:00', 'CARD', 50), (6, '2024-06-11 13:45:00', 'DD', 40),
(7, '2024-05-20 10:00:00', 'CARD', 65), (8, '2024-06-02 15:45:00', 'VOUCH', 10)
"""
VEHICLES = [
    "Honda Civic 2.0 - Manual - Plate ABX 4471",
    "Toyota Corolla 1.8 - Manual - Plate BCK 8820",
    "Mazda3 2.0 - Manual - Plate CDL 1193",
    "Chevrolet Bolt - Automatic (EV) - Plate DEM 2204",
    "Hyundai Elantra 2.0 - Automatic - Plate EFP 6657",
    "Volkswagen Golf 1.4 - Manual - Plate FGS 3318",
]


def seed_dataset(spark: SparkSession) -> Dataset:
    def values(rows: str, columns: str):
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

    def pairs(rows, columns: str):
        return values(", ".join(f"('{a}', '{b}')" for a, b in rows), columns)

    def empty(table: str):
        return spark.createDataFrame([], schema.struct(table))

    tables = {
        "customer_status": pairs(schema.CUSTOMER_STATUS, "customer_status_code, customer_status_description"),
        "lesson_status": pairs(schema.LESSON_STATUS, "lesson_status_code, lesson_status_description"),
        "payment_methods": pairs(schema.PAYMENT_METHODS, "payment_method_code, payment_method_description"),
        "app_roles": pairs(schema.ROLES, "role_code, role_name"),
        "addresses": values(
            ", ".join(f"({i}, '{i * 11}', 'Street {i}', 'Calgary', 'T{i}')" for i in range(1, 11)),
            "address_id, line_1_number_building, line_2_number_street, city, zip_postcode",
        ),
        "vehicles": values(
            ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(VEHICLES)), "vehicle_id, vehicle_details"
        ),
        "staff": values(
            STAFF,
            "staff_id, nickname, first_name, last_name, date_of_birth, date_joined_staff, date_left_staff, "
            "other_staff_details, customer_status_code",
        ),
        "customers": values(
            CUSTOMERS,
            "customer_id, customer_address_id, customer_status_code, date_became_customer, date_of_birth, first_name, last_name",
        ),
        "lessons": values(
            LESSONS, "lesson_id, customer_id, lesson_status_code, staff_id, vehicle_id, lesson_date, hour, price"
        ).selectExpr("*", "hour * 3600 AS lesson_time_sec"),
        "payments": values(PAYMENTS, "customer_id, datetime_payment, payment_method_code, amount_payment"),
        "app_users": empty("app_users"),
        "app_user_roles": empty("app_user_roles"),
        "app_login_audit": empty("app_login_audit"),
        "lesson_audit_log": empty("lesson_audit_log"),
    }
    return Dataset(spark, {n: (lambda n=n, df=df: conform(df, n)) for n, df in tables.items()})
