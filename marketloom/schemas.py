"""Table layouts of the library. Times are nanoseconds (BIGINT) and order together with seq."""

from __future__ import annotations

BAR = "instrument_id string, event_time_ns long, seq long, open double, high double, low double, close double, volume double"
BAR_EXTENDED = BAR + ", quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"
TRADE = "instrument_id string, event_time_ns long, seq long, price double, quantity double, quote_quantity double, side string, is_buyer_maker boolean, receive_time_ns long, source string"
QUOTE = "instrument_id string, event_time_ns long, seq long, bid_price double, ask_price double, bid_size double, ask_size double"
FILL = "run_uid string, event_time_ns long, seq long, commission double"
BLOTTER = "run_uid string, trade_id long, realized_pnl double, entry_time_ns long, exit_time_ns long, quantity double, entry_price double, exit_price double"
EQUITY = "run_uid string, event_time_ns long, equity double, close double, position double"
MANIFEST = "partition_key string, feature_name string, version int, params_hash string, computed_at timestamp, row_count long, source string"
DEPTH = "snapshot_id long, instrument_id string, side string, level int, price double, size double"
KEY, ORDER = "instrument_id", ("event_time_ns", "seq")
SECOND, MINUTE, HOUR, DAY = 10**9, 60 * 10**9, 3600 * 10**9, 86_400 * 10**9
EPS = 1e-12
