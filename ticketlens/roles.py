"""Ticket column roles.

A ticket export has no declared schema; every report addresses columns by
*role*.  Inside the library a tickets DataFrame always uses the role names
below (``harmonise_headers`` maps raw export headers onto them once, at
load time), so reports never search headers per call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RECEIVED_AT = "received_at"
RETURNED_AT = "returned_at"
CUSTOMER = "customer"
PRODUCT = "product"
PRODUCT_GROUP = "product_group"
TECHNICIAN = "technician"
IS_DONE = "is_done"
IS_FAILED = "is_failed"
IS_REJECTED = "is_rejected"
ERROR_NAME = "error_name"
SERIAL = "serial"
SERVICE_TYPE = "service_type"
YEAR = "year"
MONTH = "month"
QUARTER = "quarter"
SOURCE_FILE = "source_file"

STATUS_FLAGS = (IS_DONE, IS_FAILED, IS_REJECTED)
PERIODS = (YEAR, MONTH, QUARTER)

ALL_ROLES = (RECEIVED_AT, RETURNED_AT, CUSTOMER, PRODUCT, PRODUCT_GROUP, TECHNICIAN,
             IS_DONE, IS_FAILED, IS_REJECTED, ERROR_NAME, SERIAL, SERVICE_TYPE,
             YEAR, MONTH, QUARTER)

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's, for the same header
# resolution): canonical export header -> accepted aliases, compared after
# ``clean_text``.  Kept verbatim and in their original order.
# ---------------------------------------------------------------------------
HEADER_ALIASES: dict[str, list[str]] = {
    "Tên khách hàng": ["khach hang", "ten khach", "ten kh", "cty", "cong ty", "ten cong ty"],
    "Sản phẩm": ["san pham", "ma san pham", "ma hang", "product", "ten sp"],
    "Nhóm hàng": ["nhom hang", "loai hang", "danh muc", "category"],
    "Kỹ thuật viên": ["ky thuat vien", "ktv", "nhan vien sua", "nguoi sua", "sua chua"],
    "Đã sửa xong": ["da sua", "da sua xong", "hoan tat", "xong", "done", "fix ok"],
    "Không sửa được": ["khong sua", "khong sua duoc", "that bai", "fail", "khong thanh cong"],
    "Từ chối bảo hành": ["tu choi", "khong bh", "tu choi bh", "bao hanh tu choi"],
    "Tên lỗi": ["ten loi", "loi", "mo ta loi", "loi ky thuat", "error"],
    "Ngày tiếp nhận": ["ngay nhan", "ngay tiep nhan", "thoi gian nhan", "ngay bao hanh", "ngay gui"],
    "Năm": ["nam", "year"],
    "Tháng": ["thang", "month"],
    "Quý": ["quy", "quarter"],
    "Nguồn file": ["nguon file", "file name", "ten file", "nguon"],
}

# The lookup keyword each report uses for a role (the words the
# source application searches headers with), in role order.
ROLE_KEYWORDS: dict[str, list[str]] = {
    RECEIVED_AT: ["ngày tiếp nhận", "ngay tiep nhan"],
    RETURNED_AT: ["ngay tra khach"],
    CUSTOMER: ["tên khách hàng", "khách hàng"],
    PRODUCT: ["sản phẩm"],
    PRODUCT_GROUP: ["nhóm hàng"],
    TECHNICIAN: ["kỹ thuật viên", "ktv"],
    IS_DONE: ["đã sửa xong"],
    IS_FAILED: ["không sửa được"],
    IS_REJECTED: ["từ chối bảo hành"],
    ERROR_NAME: ["tên lỗi (báo lỗi)", "tên lỗi"],
    SERIAL: ["serial"],
    SERVICE_TYPE: ["loại dịch vụ"],
    YEAR: ["năm"],
    MONTH: ["tháng"],
    QUARTER: ["quý"],
    SOURCE_FILE: ["nguồn file"],
}

# Which alias-table entry backs a role (roles without an entry have none).
ROLE_CANONICAL_HEADER: dict[str, str] = {
    CUSTOMER: "Tên khách hàng",
    PRODUCT: "Sản phẩm",
    PRODUCT_GROUP: "Nhóm hàng",
    TECHNICIAN: "Kỹ thuật viên",
    IS_DONE: "Đã sửa xong",
    IS_FAILED: "Không sửa được",
    IS_REJECTED: "Từ chối bảo hành",
    ERROR_NAME: "Tên lỗi",
    RECEIVED_AT: "Ngày tiếp nhận",
    YEAR: "Năm",
    MONTH: "Tháng",
    QUARTER: "Quý",
    SOURCE_FILE: "Nguồn file",
}


class MissingRoleError(KeyError):
    """A report needs a column role the tickets DataFrame does not have."""

    def __init__(self, roles):
        self.roles = tuple(roles)
        super().__init__(f"tickets lack required column role(s): {', '.join(self.roles)}")


def require(df: DataFrame, *roles: str) -> None:
    """One up-front role check per report (instead of per-lookup guards)."""
    missing = [r for r in roles if r not in df.columns]
    if missing:
        raise MissingRoleError(missing)
