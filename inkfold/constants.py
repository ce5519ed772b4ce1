"""Values that every part of the package agrees on."""

from pyspark.sql import types as T

# Field names of a contract record, in their declared order.
CONTRACT_FIELDS = [
    "Contract_id",
    "Contract_date",
    "Customer_company_name",
    "Customer_tax_id",
    "Customer_director_name",
    "Customer_address",
    "Standard_module_count",
    "Standard_module_name",
    "Standard_users_count",
    "Contract_start_date",
    "Contract_end_date",
    "License_fee",
    "License_fee_month",
    "License_fee_year",
    "Cloud_usage_description",
    "Concurrent_users",
    "Additional_concurrent_users",
    "Add_multi_company_count",
    "Add_multi_rate_price",
    "Optional_module_count",
    "Optional_module_details",
    "Implement_package_name",
    "Implement_price",
    "Implement_mandays",
    "Implement_payment_terms",
    "Deposit_amount",
    "Customize_man_days",
    "Customize_rate_per_day",
    "Support_rate_per_manday",
    "Support_rate_per_manday_text",
    "Mandays_count",
    "Manday_price",
    "Quotation_id",
    "Quotation_date",
    "Customer_company_signature_name",
    "Customer_authorized_signature",
    "Customer_position",
    "Customer_email",
    "Customer_witness_signature",
    "Customer_witness_email",
]

# The "not found" text, the fill marker, the characters cut from the edges of a
# value, the style of filled text, and the parts of a document in reading order.
SENTINEL = "ไม่พบข้อมูล"
MARKER = "\u2063"
EDGE_CHARACTERS = " \t\n\r'\","
FILLED_UNDERLINE = "single"
FILLED_COLOR = "FF0000"
PARTS = [
    "body",
    "header",
    "first_page_header",
    "even_page_header",
    "footer",
    "first_page_footer",
    "even_page_footer",
]

# File names of a generated contract and the texts shown when a key is absent.
RESULT_PREFIX = "สัญญา_"
RESULT_DEFAULT_PREFIX = "contract_"
RESULT_SUFFIX = ".docx"
LOGIN_ERROR_DEFAULT = "ชื่อผู้ใช้หรือรหัสผ่านไม่ถูกต้อง"
QUOTATION_ERROR_DEFAULT = "ไม่พบข้อมูลใบเสนอราคา"
UNKNOWN_CAUSE = "ไม่ทราบสาเหตุ"
DISPLAY_NAME_DEFAULT = "ผู้ใช้งาน"

# Words of the amount, instalment and date texts.
CURRENCY_WORD = "บาท"
INSTALMENT_WORD = "งวดที่"
PAY_WORD = "ชำระ"
AMOUNT_WORD = "เป็นจำนวนเงิน"
BUDDHIST_ERA_OFFSET = 543
THAI_MONTHS = [
    "มกราคม",
    "กุมภาพันธ์",
    "มีนาคม",
    "เมษายน",
    "พฤษภาคม",
    "มิถุนายน",
    "กรกฎาคม",
    "สิงหาคม",
    "กันยายน",
    "ตุลาคม",
    "พฤศจิกายน",
    "ธันวาคม",
]

# Whitespace as a regex class body: every Unicode space plus the four separator controls.
WHITESPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same characters one by one: exactly those that Python strips.
WHITESPACE_CHARACTERS = "".join(chr(code) for code in range(0x110000) if chr(code).isspace())

CONTRACT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in CONTRACT_FIELDS])
