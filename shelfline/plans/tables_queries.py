from ..sources import derived as d
from .registry import register

PANEL = "sku_id, date, demand, on_hand, lead_time_days, unit_cost, unit_price, supplier, category"
register("panel_weekly", d.panel_bt, f"select {PANEL} from panel")
register("panel_monthly", d.panel_pm, f"select {PANEL} from panel_pm")
register("suppliers_table", d.suppliers, "select * from suppliers")
register("receipts_table", d.receipts, "select * from receipts")
register("po_lines_table", d.po_lines, "select * from po_lines")
register("po_status_log_table", lambda s, f: d.po_status_log(s, f).drop("note"), "select * from po_status_log")
register("purchase_orders_table",
         lambda s, f: d.purchase_orders(s, f).drop("joint_replen_group", "assigned_to", "approved_by", "notes"),
         "select * from purchase_orders")
