"""Explicit schemas of every table the engine reads or writes. Session times are IST wall clock without a zone."""

TICK = "symbol string, ts timestamp_ntz, ltp double, qty double, seq bigint"
CANDLE = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CANDLE_FILE = "timestamp timestamp_ntz, open double, high double, low double, close double, volume double"
INSTRUMENT = "exchange string, symbol string"
CALENDAR_FILE = "holidays array<string>, special_open array<string>, _comment string, _last_updated string"
CALENDAR = "d date, kind string"
QUOTE_MESSAGE = "type string, status string, symbol string, data struct<symbol:string,ltp:double,ltt:bigint,last_trade_quantity:double>"
LEVELS = "array<struct<price:double,quantity:bigint>>"
DEPTH_MESSAGE = f"type string, status string, symbol string, data struct<symbol:string,ltt:bigint,ltp:double,bids:{LEVELS},asks:{LEVELS},buy:{LEVELS},sell:{LEVELS},depth:struct<buy:{LEVELS},sell:{LEVELS}>>"
DEPTH = f"symbol string, ts_ms bigint, ltp double, bids {LEVELS}, asks {LEVELS}"
CONNECTION = "event string, ts_ms bigint, day date, mode string, note string"
SIGNAL = "symbol string, exchange string, ref_ts timestamp_ntz, ts timestamp_ntz, seq bigint, side string, price double"
TRADE = "symbol string, exchange string, side string, entry_ts timestamp_ntz, entry_price double, stop_price double, exit_ts timestamp_ntz, exit_price double"
