"""Schemas of market data. Prices are ten-thousandths of a currency unit in longs; times are nanoseconds in longs."""

TRADES = "trade_seq long, order_id long, symbol long, price_e4 long, quantity long, ts_ns long, side string, venue int, is_hidden boolean"
QUOTES = "quote_seq long, symbol long, bid_e4 long, ask_e4 long, bid_size long, ask_size long, ts_ns long, venue int"
ORDERS = "order_id long, symbol long, price_e4 long, quantity long, remaining_quantity long, ts_ns long, side string, order_type string, venue int"
LEVEL = "array<struct<price_e4:long,quantity:long,order_count:int>>"
BOOKS = f"symbol long, ts_ns long, venue int, bids {LEVEL}, asks {LEVEL}"
ANOMALIES = "symbol long, ts_ns long, detector string, type string, confidence double, magnitude double, estimated_hidden_size long, expected_impact long, description string, metadata map<string,double>"
VENUES = (
    "venue_id string, avg_spread_bps double, fill_probability double, avg_fill_size double, market_impact_bps double, fee_bps double, rebate_bps double, "
    "avg_latency_us long, hidden_liquidity_ratio double, supports_hidden boolean, supports_pegging boolean, order_types array<string>"
)
