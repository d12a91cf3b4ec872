"""The queries of `catalog.py` as SQL over the plain test tables.

Written without slices, halos or carried state: windows run over whole series here, so that a
wrong cut on the Spark side shows as a difference.
"""

from __future__ import annotations

from countermill.plans.bindings import START_US

SQL: dict[str, str] = {}

DAY_US = 86400000000

# ---------------------------------------------------------------- inputs as common table expressions

CTES: dict[str, str] = {
    "base": """
        SELECT *, epoch_us(ts) AS us, 'DEV_' || CAST(user_id AS VARCHAR) AS device_id,
               (epoch_us(ts) // 100 + user_id * 7919 + CAST(floor(value * 100) AS BIGINT)) % 4294967296 AS counter
        FROM events""",
    "polls": """
        SELECT device_id, CAST(user_id % 4 AS INTEGER) AS channel, us, event_id AS seq,
               event_type <> 'error' AS success, (event_id % 97 + 1) * 1000 AS acquisition_us,
               CASE WHEN event_type = 'error' THEN 'read failed' END AS error,
               CASE WHEN event_type = 'error' THEN NULL
                    WHEN event_id % 50 = 7 THEN []
                    WHEN event_id % 50 = 8 THEN [counter & 65535]
                    WHEN event_id % 50 = 9 THEN [counter & 65535, counter >> 16, 17]
                    ELSE [counter & 65535, counter >> 16] END AS registers
        FROM base""",
    "blocks": """
        SELECT device_id, us, event_id AS seq, k AS channel,
               CASE WHEN event_type = 'error' OR (event_id % 10 = 3 AND k = 3) THEN NULL
                    ELSE ((counter >> 16) + k) % 65536 * 65536 + (counter & 65535) END AS count
        FROM base CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)""",
    "channels": """
        SELECT 'DEV_' || CAST(c_custkey AS VARCHAR) AS device_id, n AS channel, c_mktsegment,
               CASE n WHEN 0 THEN 'Production_' WHEN 1 THEN 'Temperature_' WHEN 2 THEN 'Flow_' ELSE 'Channel_' END
                 || CAST(c_custkey AS VARCHAR) AS name,
               CASE n WHEN 0 THEN 'Counter ' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'Probe' WHEN 2 THEN '  ' END AS description,
               (n <> 3 OR c_acctbal >= 0) AS enabled, n * 2 AS start_register, 2 AS register_count,
               CAST(CASE n WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.01 ELSE 0.5 END AS DOUBLE) AS scale_factor,
               CAST(CASE n WHEN 0 THEN 0.0 WHEN 1 THEN -273.15 WHEN 2 THEN 0.0 ELSE 100.0 END AS DOUBLE) AS "offset",
               CASE n WHEN 0 THEN 'parts' WHEN 1 THEN 'celsius' WHEN 2 THEN 'litres' ELSE 'counts' END AS unit,
               CASE n WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS decimal_places,
               CASE n WHEN 0 THEN 0 WHEN 2 THEN 1000000 WHEN 3 THEN 0 END AS min_value,
               CASE n WHEN 0 THEN 4294967295 WHEN 1 THEN 4000000000 WHEN 3 THEN 4200000000 END AS max_value,
               CAST(CASE n WHEN 1 THEN 10000 WHEN 2 THEN 10050 WHEN 3 THEN 12000 END AS DOUBLE) AS max_rate_of_change,
               CASE n WHEN 0 THEN 4000000000 WHEN 3 THEN 3900000000 ELSE 4294000000 END AS overflow_threshold,
               n <> 2 AS overflow_check
        FROM customer CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS n)""",
    "devices": """
        SELECT 'DEV_' || CAST(c_custkey AS VARCHAR) AS device_id, c_mktsegment AS line,
               'site_' || CAST(c_nationkey AS VARCHAR) AS location, c_acctbal
        FROM customer""",
    "lines": "SELECT device_id, line FROM devices WHERE c_acctbal >= 0",
    "decoded": """
        SELECT p.*, c.* EXCLUDE (device_id, channel),
               CASE WHEN len(registers) >= 2 THEN (CAST(registers[2] AS BIGINT) << 16) | registers[1]
                    WHEN len(registers) = 1 THEN registers[1] END AS raw_value
        FROM polls p JOIN channels c USING (device_id, channel)
        WHERE p.success AND c.enabled""",
    "valued": """
        SELECT *, CASE WHEN len(registers) = 0 THEN 'no register words' END AS error_message,
               round_even((raw_value * scale_factor + "offset") * pow(10, decimal_places), 0)
                 / pow(10, decimal_places) + 0.0 AS processed_value
        FROM decoded""",
    "rated": f"""
        SELECT * EXCLUDE (o), CASE WHEN processed_value IS NOT NULL AND us > o.us THEN
                 (CASE WHEN raw_value < o.raw THEN raw_value - o.raw + 4294967295 ELSE raw_value - o.raw END)
                 / ((us - o.us) / 1e6) END AS rate
        FROM (SELECT *, min(CASE WHEN processed_value IS NOT NULL
                                 THEN struct_pack(us := us, seq := seq, raw := raw_value) END)
                        OVER (PARTITION BY device_id, channel ORDER BY us
                              RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS o FROM valued)""",
    "graded": """
        SELECT *, CASE WHEN error_message IS NOT NULL THEN 5
                       WHEN raw_value < min_value OR raw_value > max_value THEN 2
                       WHEN abs(rate) > max_rate_of_change THEN 1
                       WHEN overflow_check AND raw_value > overflow_threshold THEN 6
                       ELSE 0 END AS quality
        FROM rated""",
    "readings": """
        SELECT device_id, channel, seq, us, CASE WHEN error_message IS NULL THEN raw_value ELSE 0 END AS raw_value,
               processed_value, rate, quality,
               CASE quality WHEN 0 THEN 'Good' WHEN 1 THEN 'Uncertain' WHEN 2 THEN 'Bad'
                            WHEN 5 THEN 'ConfigurationError' WHEN 6 THEN 'Overflow' END AS quality_name,
               unit, acquisition_us, error_message,
               CASE WHEN error_message IS NULL AND channel <> 3 THEN c_mktsegment END AS line
        FROM graded""",
    "tagged": """
        SELECT d.*, v.location, v.line AS device_line,
               list_filter([
                 'channel_type=counter',
                 'unit=' || CASE channel WHEN 1 THEN 'fahrenheit' WHEN 2 THEN 'litres' END,
                 'line=' || CASE WHEN channel <> 3 THEN c_mktsegment END,
                 'data_source=adam_logger',
                 'channel_name=' || name,
                 'channel_description=' || CASE WHEN channel < 2 THEN description END,
                 'register_start=' || CAST(start_register AS VARCHAR),
                 'register_count=2',
                 'scale_factor=' || CAST(scale_factor AS VARCHAR),
                 'offset=' || CASE WHEN "offset" <> 0 THEN CAST("offset" AS VARCHAR) END,
                 'device_type=adam_6051'], lambda x: x IS NOT NULL) AS pairs
        FROM decoded d LEFT JOIN devices v USING (device_id)""",
    "counters": """
        SELECT device_id, channel, us, seq,
               CASE WHEN len(registers) >= 2 THEN (CAST(registers[2] AS BIGINT) << 16) | registers[1]
                    ELSE registers[1] END AS raw_value
        FROM polls WHERE success AND len(registers) > 0""",
    "crated": f"""
        SELECT * EXCLUDE (o), CASE WHEN us > o.us THEN
                 (CASE WHEN raw_value < o.raw THEN raw_value - o.raw + 4294967295 ELSE raw_value - o.raw END)
                 / ((us - o.us) / 1e6) END AS rate
        FROM (SELECT *, min(struct_pack(us := us, seq := seq, raw := raw_value))
                        OVER (PARTITION BY device_id, channel ORDER BY us
                              RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS o FROM counters)""",
    "brated": f"""
        SELECT * EXCLUDE (o), CASE WHEN us > o.us THEN (count - o.raw) / ((us - o.us) / 1e6) END AS rate
        FROM (SELECT *, min(struct_pack(us := us, seq := seq, raw := count))
                        OVER (PARTITION BY device_id, channel ORDER BY us
                              RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) AS o
              FROM blocks WHERE count IS NOT NULL)""",
    "probes": """
        SELECT device_id, us + 30000000 AS us, event_id + 1000000000 AS seq, 'probe' AS kind,
               value > 20 AS success, CAST(NULL AS VARCHAR) AS error
        FROM base WHERE event_type = 'purchase'""",
    "reads": """
        SELECT device_id, us + acquisition_us AS us, seq, 'read' AS kind, success, error FROM polls""",
    "checks": "SELECT * FROM reads UNION ALL SELECT * FROM probes",
    "health": f"""
        SELECT device_id, us, seq, kind,
               CASE WHEN success THEN 0 ELSE 2 END AS status,
               CASE WHEN success THEN 'Online' ELSE 'Error' END AS status_name, success AS is_connected,
               last_value(CASE WHEN success THEN us - prev END IGNORE NULLS) OVER w AS last_successful_read_us,
               rn - coalesce(max(CASE WHEN success THEN rn END) OVER w, 0) AS consecutive_failures,
               CASE WHEN NOT success THEN error END AS last_error, rn AS total_reads,
               count(*) FILTER (success) OVER w AS successful_reads,
               CAST(count(*) FILTER (success) OVER w AS DOUBLE) / rn * 100 AS success_rate
        FROM (SELECT *, row_number() OVER s AS rn, lag(us, 1, {START_US}) OVER s AS prev FROM checks
              WINDOW s AS (PARTITION BY device_id ORDER BY us, seq))
        WINDOW w AS (PARTITION BY device_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "latest": """
        SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY us DESC, seq DESC) = 1""",
    "items": """
        SELECT 'SUP_' || CAST(l_suppkey AS VARCHAR) AS device_id, l_linenumber AS channel, epoch_us(l_shipdate) AS us,
               CAST(floor(l_extendedprice * 100) AS BIGINT) AS counter, l_returnflag <> 'R' AS success,
               CAST(l_quantity AS BIGINT) * 1000 AS acquisition_us,
               l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS seq
        FROM lineitem""",
    "supplier_channels": """
        SELECT 'SUP_' || CAST(s_suppkey AS VARCHAR) AS device_id, n AS channel, n <> 7 OR s_acctbal >= 0 AS enabled
        FROM supplier CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS n)""",
    "log": """
        SELECT device_id, us, event_id AS seq,
               CASE WHEN event_type <> 'signup' THEN 'read'
                    ELSE ['add', 'remove', 'update', 'probe'][event_id % 4 + 1] END AS kind,
               event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN 'read failed ' || CAST(event_id AS VARCHAR) END AS error
        FROM base""",
    "rule_channels": """
        SELECT 'RULE_' || CAST(k // 8 AS VARCHAR) AS device_id,
               CAST(CASE WHEN k % 101 = 0 THEN 300 WHEN k % 103 = 0 THEN -1 WHEN k % 107 = 0 THEN (k + 1) % 8
                         ELSE k % 8 END AS INTEGER) AS channel,
               CASE WHEN k % 109 = 0 THEN ' ' WHEN k % 113 = 0 THEN repeat(p_name, 20) ELSE p_name END AS name,
               p_size > 3 AS enabled,
               CASE WHEN k % 127 = 0 THEN 65530 ELSE k % 100 END AS start_register,
               CASE WHEN k % 127 = 0 THEN 10 WHEN k % 131 = 0 THEN 0 ELSE 2 END AS register_count,
               CASE WHEN k % 137 = 0 THEN 0.0 ELSE 1.0 END AS scale_factor,
               CASE WHEN k % 139 = 0 THEN -1 ELSE k % 4 END AS decimal_places,
               CASE WHEN k % 149 = 0 THEN 9000 ELSE 0 END AS min_value,
               CASE WHEN k % 3 <> 0 THEN p_size * 100 END AS max_value,
               CASE WHEN k % 151 = 0 THEN -1.0 WHEN k % 2 = 0 THEN 1000.0 END AS max_rate_of_change
        FROM (SELECT *, p_partkey AS k FROM part)""",
    "rule_devices": """
        SELECT 'FLEET_' || CAST(c_nationkey AS VARCHAR) AS fleet_id,
               'RULE_' || CASE WHEN k % 24 = 0 THEN lpad(CAST(k AS VARCHAR), 50, '0') ELSE CAST(k AS VARCHAR) END AS device_id,
               CASE WHEN k % 21 = 0 THEN '' WHEN k % 22 = 0 THEN '300.1.2.3' WHEN k % 23 = 0 THEN 'fe80::1'
                    ELSE '10.0.' || CAST(k % 256 AS VARCHAR) || '.9' END AS ip_address,
               k, copy
        FROM (SELECT c_custkey AS k, c_nationkey, unnest(CASE WHEN c_custkey % 50 = 7 THEN [0, 1] ELSE [0] END) AS copy
              FROM customer)""",
    "channel_findings": """
        SELECT 'channel' AS level, f.stage, CAST(NULL AS VARCHAR) AS fleet_id, device_id, channel, f.rule, f.message, f.members
        FROM (SELECT device_id, channel, unnest(list_filter([
          CASE WHEN channel < 0 OR channel > 255 THEN {'stage': 'attribute', 'rule': 'channel_number_range',
            'message': 'ChannelNumber must be between 0 and 255', 'members': 'ChannelNumber'} END,
          CASE WHEN register_count < 1 OR register_count > 4 THEN {'stage': 'attribute', 'rule': 'register_count_range',
            'message': 'RegisterCount must be between 1 and 4', 'members': 'RegisterCount'} END,
          CASE WHEN decimal_places < 0 THEN {'stage': 'attribute', 'rule': 'decimal_places_range',
            'message': 'DecimalPlaces must be between 0 and 10', 'members': 'DecimalPlaces'} END,
          CASE WHEN trim(name) = '' THEN {'stage': 'attribute', 'rule': 'name_required',
            'message': 'Channel name is required', 'members': 'Name'} END,
          CASE WHEN length(name) > 100 THEN {'stage': 'attribute', 'rule': 'name_length',
            'message': 'Channel name must be 100 characters or less', 'members': 'Name'} END,
          CASE WHEN trim(name) = '' THEN {'stage': 'object', 'rule': 'name_blank',
            'message': 'Channel name is required and cannot be empty', 'members': 'Name'} END,
          CASE WHEN min_value > max_value THEN {'stage': 'object', 'rule': 'min_above_max',
            'message': 'MinValue cannot be greater than MaxValue', 'members': 'MinValue,MaxValue'} END,
          CASE WHEN scale_factor = 0 THEN {'stage': 'object', 'rule': 'scale_zero',
            'message': 'ScaleFactor cannot be zero', 'members': 'ScaleFactor'} END,
          CASE WHEN max_rate_of_change <= 0 THEN {'stage': 'object', 'rule': 'rate_limit_not_positive',
            'message': 'MaxRateOfChange must be positive if specified', 'members': 'MaxRateOfChange'} END,
          CASE WHEN register_count <= 0 THEN {'stage': 'object', 'rule': 'register_count_not_positive',
            'message': 'RegisterCount must be positive', 'members': 'RegisterCount'} END,
          CASE WHEN start_register + register_count > 65535 THEN {'stage': 'object', 'rule': 'register_end',
            'message': 'StartRegister + RegisterCount exceeds maximum Modbus address range',
            'members': 'StartRegister,RegisterCount'} END], lambda x: x IS NOT NULL)) AS f FROM rule_channels)""",
    "device_own": """
        SELECT 'device' AS level, f.stage, fleet_id, device_id, CAST(NULL AS INTEGER) AS channel, f.rule, f.message, f.members
        FROM (SELECT fleet_id, device_id, unnest(list_filter([
          CASE WHEN k % 15 = 0 THEN {'stage': 'attribute', 'rule': 'port_range',
            'message': 'Port must be between 1 and 65535', 'members': 'Port'} END,
          CASE WHEN k % 16 = 0 THEN {'stage': 'attribute', 'rule': 'unit_id_range',
            'message': 'UnitId must be between 1 and 255', 'members': 'UnitId'} END,
          CASE WHEN k % 17 = 0 THEN {'stage': 'attribute', 'rule': 'timeout_range',
            'message': 'Timeout must be between 500ms and 30 seconds', 'members': 'TimeoutMs'} END,
          CASE WHEN k % 18 = 0 THEN {'stage': 'attribute', 'rule': 'max_retries_range',
            'message': 'MaxRetries must be between 0 and 10', 'members': 'MaxRetries'} END,
          CASE WHEN k % 19 = 0 THEN {'stage': 'attribute', 'rule': 'retry_delay_range',
            'message': 'RetryDelayMs must be between 100ms and 10 seconds', 'members': 'RetryDelayMs'} END,
          CASE WHEN k % 25 = 0 THEN {'stage': 'attribute', 'rule': 'receive_buffer_range',
            'message': 'ReceiveBufferSize must be between 1KB and 64KB', 'members': 'ReceiveBufferSize'} END,
          CASE WHEN k % 26 = 0 THEN {'stage': 'attribute', 'rule': 'send_buffer_range',
            'message': 'SendBufferSize must be between 1KB and 64KB', 'members': 'SendBufferSize'} END,
          CASE WHEN k % 27 = 0 THEN {'stage': 'attribute', 'rule': 'rate_window_range',
            'message': 'RateWindowSeconds must be between 10 seconds and 1 hour', 'members': 'RateWindowSeconds'} END,
          CASE WHEN k % 28 = 0 THEN {'stage': 'attribute', 'rule': 'overflow_threshold_range',
            'message': 'OverflowThreshold must be reasonable for 32-bit counters', 'members': 'OverflowThreshold'} END,
          CASE WHEN length(device_id) > 50 THEN {'stage': 'attribute', 'rule': 'device_id_length',
            'message': 'DeviceId must be 50 characters or less', 'members': 'DeviceId'} END,
          CASE WHEN ip_address = '' THEN {'stage': 'attribute', 'rule': 'ip_required',
            'message': 'IP Address is required', 'members': 'IpAddress'} END,
          CASE WHEN ip_address IN ('', '300.1.2.3') THEN {'stage': 'object', 'rule': 'ip_invalid',
            'message': 'Valid IP address is required', 'members': 'IpAddress'} END,
          CASE WHEN device_id NOT IN (SELECT device_id FROM rule_channels) THEN {'stage': 'object', 'rule': 'no_channels',
            'message': 'At least one channel must be configured', 'members': 'Channels'} END],
          lambda x: x IS NOT NULL)) AS f FROM rule_devices)""",
    "device_twice": """
        SELECT 'device' AS level, 'object' AS stage, CAST(NULL AS VARCHAR) AS fleet_id, device_id, channel,
               'duplicate_channel' AS rule,
               'Duplicate channel numbers are not allowed: ' || CAST(channel AS VARCHAR) AS message, 'Channels' AS members
        FROM rule_channels GROUP BY device_id, channel HAVING count(*) > 1""",
    "device_findings": """
        SELECT * FROM device_own UNION ALL SELECT * FROM device_twice UNION ALL
        SELECT * REPLACE ('Channel ' || CAST(channel AS VARCHAR) || ': ' || message AS message) FROM channel_findings""",
    "load": """
        SELECT f.n_nationkey, 'FLEET_' || CAST(f.n_nationkey AS VARCHAR) AS fleet_id, coalesce(x.devices, 0) AS devices,
               coalesce(x.enabled, 0) AS enabled_channels, coalesce(x.enabled, 0) * 50 AS estimated_cycle_ms,
               CASE WHEN n_nationkey % 5 = 0 THEN 50 ELSE 5000 END AS poll_interval_ms,
               CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 50 END AS max_concurrent_devices
        FROM nation f LEFT JOIN (
          SELECT fleet_id, count(*) AS devices, sum(n) AS enabled
          FROM (SELECT d.fleet_id, d.device_id, d.copy, count(c.device_id) AS n
                FROM rule_devices d LEFT JOIN (SELECT * FROM rule_channels WHERE enabled) c USING (device_id)
                GROUP BY ALL) GROUP BY fleet_id) x
          ON x.fleet_id = 'FLEET_' || CAST(f.n_nationkey AS VARCHAR)""",
    "fleet_own": """
        SELECT 'fleet' AS level, f.stage, fleet_id, CAST(NULL AS VARCHAR) AS device_id, CAST(NULL AS INTEGER) AS channel,
               f.rule, f.message, f.members
        FROM (SELECT fleet_id, unnest(list_filter([
          CASE WHEN n_nationkey % 5 = 0 THEN {'stage': 'attribute', 'rule': 'poll_interval_range',
            'message': 'PollIntervalMs must be between 100ms and 5 minutes', 'members': 'PollIntervalMs'} END,
          CASE WHEN n_nationkey % 6 = 0 THEN {'stage': 'attribute', 'rule': 'health_check_range',
            'message': 'HealthCheckIntervalMs must be between 5 seconds and 5 minutes', 'members': 'HealthCheckIntervalMs'} END,
          CASE WHEN n_nationkey % 7 = 0 THEN {'stage': 'attribute', 'rule': 'concurrency_range',
            'message': 'MaxConcurrentDevices must be between 1 and 50', 'members': 'MaxConcurrentDevices'} END,
          CASE WHEN n_nationkey % 8 = 0 THEN {'stage': 'attribute', 'rule': 'data_buffer_range',
            'message': 'DataBufferSize must be between 100 and 100,000', 'members': 'DataBufferSize'} END,
          CASE WHEN n_nationkey % 9 = 0 THEN {'stage': 'attribute', 'rule': 'batch_size_range',
            'message': 'BatchSize must be between 1 and 1,000', 'members': 'BatchSize'} END,
          CASE WHEN n_nationkey % 10 = 0 THEN {'stage': 'attribute', 'rule': 'batch_timeout_range',
            'message': 'BatchTimeoutMs must be between 100ms and 30 seconds', 'members': 'BatchTimeoutMs'} END,
          CASE WHEN n_nationkey % 11 = 0 THEN {'stage': 'attribute', 'rule': 'consecutive_failures_range',
            'message': 'MaxConsecutiveFailures must be between 1 and 100', 'members': 'MaxConsecutiveFailures'} END,
          CASE WHEN n_nationkey % 12 = 0 THEN {'stage': 'attribute', 'rule': 'device_timeout_range',
            'message': 'DeviceTimeoutMinutes must be between 1 and 60 minutes', 'members': 'DeviceTimeoutMinutes'} END,
          CASE WHEN devices > max_concurrent_devices THEN {'stage': 'object', 'rule': 'too_many_devices',
            'message': 'Number of devices (' || devices || ') exceeds MaxConcurrentDevices (' || max_concurrent_devices
              || '). This may impact performance.', 'members': 'Devices,MaxConcurrentDevices'} END,
          CASE WHEN estimated_cycle_ms > poll_interval_ms THEN {'stage': 'object', 'rule': 'poll_too_short',
            'message': 'Polling interval (' || poll_interval_ms || 'ms) may be too short for ' || enabled_channels
              || ' channels. Consider increasing to at least ' || estimated_cycle_ms || 'ms.',
            'members': 'PollIntervalMs'} END], lambda x: x IS NOT NULL)) AS f FROM load)""",
    "fleet_twice": """
        SELECT 'fleet' AS level, 'object' AS stage, fleet_id, CAST(NULL AS VARCHAR) AS device_id,
               CAST(NULL AS INTEGER) AS channel, 'duplicate_device' AS rule,
               'Duplicate device IDs found: ' || device_id AS message, 'Devices' AS members
        FROM rule_devices GROUP BY fleet_id, device_id HAVING count(*) > 1""",
    "custom_rated": f"""
        SELECT * EXCLUDE (o), CASE WHEN raw_value IS NOT NULL AND us > o.us THEN
                 (CASE WHEN raw_value < o.raw THEN raw_value - o.raw + 4294967295 ELSE raw_value - o.raw END)
                 / ((us - o.us) / 1e6) END AS rate
        FROM (SELECT *, min(CASE WHEN raw_value IS NOT NULL THEN struct_pack(us := us, seq := seq, raw := raw_value) END)
                        OVER (PARTITION BY device_id, channel ORDER BY us
                              RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS o FROM decoded)""",
    "custom_graded": """
        SELECT *, CASE WHEN raw_value IS NULL THEN 5 WHEN raw_value < 0 THEN 2
                       WHEN contains(name, 'Production') AND raw_value > 1000000 THEN 1
                       WHEN abs(rate) > 1000 THEN 1 ELSE 0 END AS quality
        FROM custom_rated""",
    "scripts": """
        SELECT s_suppkey AS k, 'SUP_' || CAST(s_suppkey AS VARCHAR) AS device_id,
               CASE WHEN s_suppkey % 4 < 2 THEN [0, 1] ELSE range(s_suppkey % 4 + 1) END AS channels
        FROM supplier""",
}

# What each expression builds on, in order.
NEEDS: dict[str, list[str]] = {
    "polls": ["base"],
    "blocks": ["base"],
    "lines": ["devices"],
    "decoded": ["polls", "channels"],
    "valued": ["decoded"],
    "rated": ["valued"],
    "graded": ["rated"],
    "readings": ["graded"],
    "tagged": ["decoded", "devices"],
    "counters": ["polls"],
    "crated": ["counters"],
    "brated": ["blocks"],
    "probes": ["base"],
    "reads": ["polls"],
    "checks": ["reads", "probes"],
    "health": ["checks"],
    "latest": ["health"],
    "log": ["base"],
    "channel_findings": ["rule_channels"],
    "device_own": ["rule_devices", "rule_channels"],
    "device_twice": ["rule_channels"],
    "device_findings": ["device_own", "device_twice", "channel_findings"],
    "load": ["rule_devices", "rule_channels"],
    "fleet_own": ["load"],
    "fleet_twice": ["rule_devices"],
    "custom_rated": ["decoded"],
    "custom_graded": ["custom_rated"],
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in [*_ordered(NEEDS.get(name, [])), name] if n not in out]
    return out


def sql(name: str, needs: str, body: str) -> None:
    """Register a query; a body that begins with a comma adds expressions of its own."""
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in _ordered(needs.split()))
    SQL[name] = f"WITH {ctes}\n{body}" if ctes else body


# ---------------------------------------------------------------- sources and sinks

POLL_LIST = "device_id, channel, us, success, acquisition_us, error, seq"
READING_LIST = """device_id, channel, seq, us, raw_value, processed_value, rate, quality, quality_name, unit,
    acquisition_us, error_message"""
HEALTH_LIST = """device_id, us, seq, kind, status, status_name, is_connected, last_successful_read_us,
    consecutive_failures, last_error, total_reads, successful_reads, success_rate"""
ISO = """strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN us % 1000000 <> 0 THEN '.' || {fraction} ELSE '' END || '+00:00'"""
ISO_FULL = ISO.format(fraction="lpad(CAST(us % 1000000 AS VARCHAR), 6, '0')")
ISO_TRIM = ISO.format(fraction="rtrim(lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '0')")

sql(
    "read_register_log",
    "polls",
    f"SELECT {POLL_LIST}, array_to_string(registers, ',') AS registers FROM polls",
)
sql("stream_register_log", "polls", f"SELECT {POLL_LIST} FROM polls")
sql(
    "load_device_config",
    "",
    """
    SELECT 'FLEET_' || CAST(s_suppkey AS VARCHAR) AS fleet_id, 'SUP_' || CAST(s_suppkey AS VARCHAR) AS device_id,
           '10.1.0.' || CAST(s_suppkey % 250 AS VARCHAR) AS ip_address,
           CASE WHEN s_suppkey % 4 = 0 THEN 5020 ELSE 502 END AS port, 1 AS unit_id, 3000 AS timeout_ms,
           'nation_' || CAST(s_nationkey AS VARCHAR) AS location, n AS channel,
           'Part_' || CAST(n AS VARCHAR) || '_' || CAST(s_suppkey AS VARCHAR) AS name,
           CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS scale_factor, 'counts' AS unit,
           2 AS register_count, true AS enabled, s_suppkey * 10 + n AS max_value,
           CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 7 = 2 THEN 4294000000 WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 2000000 END
             AS overflow_threshold,
           s_suppkey % 3 <> 1 AND s_suppkey % 7 <> 2 AS overflow_check
    FROM supplier CROSS JOIN (SELECT CAST(unnest(range(2)) AS INTEGER) AS n) WHERE s_suppkey % 23 <> 6""",
)
sql(
    "document_findings",
    "",
    """
    WITH whole AS (SELECT s_suppkey AS k, 'FLEET_' || s_suppkey AS fleet_id, 'SUP_' || s_suppkey AS device_id
                   FROM supplier WHERE s_suppkey % 23 <> 6)
    SELECT level, 'document' AS stage, fleet_id, device_id, channel, rule, message, members FROM (
      SELECT 'fleet' AS level, NULL AS fleet_id, NULL AS device_id, CAST(NULL AS INTEGER) AS channel, 'malformed_document' AS rule,
             'The configuration document is not valid JSON' AS message, '' AS members
      FROM supplier WHERE s_suppkey % 23 = 6
      UNION ALL SELECT 'fleet', fleet_id, NULL, NULL, 'mistyped_setting',
                       'The value of BatchSize does not have its type: 2.5', 'BatchSize' FROM whole WHERE k % 17 = 4
      UNION ALL SELECT 'device', fleet_id, device_id, NULL, 'mistyped_setting',
                       'The value of Port does not have its type: abc', 'Port' FROM whole WHERE k % 4 <> 0 AND k % 11 = 3
      UNION ALL SELECT 'channel', fleet_id, device_id, CAST(unnest([0, 1]) AS INTEGER), 'mistyped_setting',
                       'The value of Enabled does not have its type: no', 'Enabled' FROM whole WHERE k % 13 = 5)""",
)
sql(
    "apply_config_defaults",
    "scripts",
    """
    SELECT device_id, CASE WHEN k % 2 = 0 THEN '10.2.0.' || CAST(k % 250 AS VARCHAR) ELSE '192.168.1.100' END AS host,
           CASE WHEN k % 3 = 0 THEN k % 7 ELSE 3 END AS retries, 502 AS port, array_to_string(channels, ',') AS channels,
           CAST(CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN 30 ELSE 60 END AS BIGINT) AS rate_window,
           4294967000 AS overflow_threshold, 'adam_counters' AS database, CAST(5.0 AS DOUBLE) AS poll_interval,
           'default' AS location
    FROM scripts""",
)
sql("legacy_channel_list", "scripts", "SELECT device_id, CAST(unnest(channels) AS INTEGER) AS channel FROM scripts")
POINTS = f"""
    SELECT 'counter_data' AS measurement, b.device_id AS device, d.location, CAST(b.channel AS VARCHAR) AS channel,
           {ISO_FULL} AS time, b.count, b.rate
    FROM brated b LEFT JOIN devices d USING (device_id)"""
sql("to_points", "brated devices", POINTS)
sql("write_points", "brated devices", POINTS)
sql(
    "to_messages",
    "readings",
    f"""
    SELECT 'adam.data.' || device_id || '.' || CAST(channel AS VARCHAR) AS topic, device_id AS "DeviceId",
           channel AS "Channel", raw_value AS "RawValue", processed_value AS "ProcessedValue", {ISO_TRIM} AS "Timestamp",
           quality AS "Quality", rate AS "Rate"
    FROM readings""",
)
sql(
    "audit_trail",
    "readings",
    """
    SELECT us AS "Timestamp", device_id AS "DeviceId", channel AS "Channel", processed_value AS "Value",
           'ADAM_Logger' AS "Source", 'operator' AS "UserId", 'batch-1' AS "BatchId"
    FROM readings WHERE quality = 0""",
)

# ---------------------------------------------------------------- scalar functions

sql(
    "decode_registers",
    "polls",
    """
    SELECT device_id, seq, CAST(len(registers) AS INTEGER) AS words,
           CASE WHEN len(registers) >= 2 THEN (CAST(registers[2] AS BIGINT) << 16) | registers[1]
                WHEN len(registers) = 1 THEN registers[1] END AS raw_value
    FROM polls""",
)
sql("decode_register_block", "blocks", "SELECT device_id, us, seq, channel, count FROM blocks")
sql("transform_value", "valued", "SELECT device_id, channel, seq, raw_value, processed_value FROM valued")
TEMPERATURE = """
    round_even((CASE WHEN contains(name, 'Temperature') THEN (raw_value * scale_factor + "offset") * 9.0::DOUBLE / 5.0::DOUBLE + 32
                     ELSE raw_value * scale_factor + "offset" END) * pow(10, decimal_places), 0)
      / pow(10, decimal_places) + 0.0"""
sql("transform_temperature", "decoded", f"SELECT device_id, channel, seq, {TEMPERATURE} AS processed_value FROM decoded")
sql(
    "enrich_tags",
    "tagged",
    """
    SELECT device_id, seq, array_to_string(list_sort(list_concat(pairs,
             ['device_location=' || location, 'device_line=' || device_line])), ';') AS tags FROM tagged""",
)
sql("enrich_tags_compat", "tagged", "SELECT device_id, seq, array_to_string(list_sort(pairs), ';') AS tags FROM tagged")
sql(
    "shift_tag",
    "polls devices",
    """
    SELECT device_id, seq, 'location=' || coalesce(location, 'unknown') || ';shift='
             || CASE WHEN h >= 6 AND h < 14 THEN 'day' WHEN h >= 14 AND h < 22 THEN 'evening' ELSE 'night' END AS tags
    FROM (SELECT p.*, hour(make_timestamp(us + 32400000000)) AS h FROM polls p) LEFT JOIN devices USING (device_id)""",
)
sql(
    "error_reading",
    "valued",
    """
    SELECT device_id, channel, seq, us, CAST(0 AS BIGINT) AS raw_value, CAST(NULL AS DOUBLE) AS processed_value,
           CAST(NULL AS DOUBLE) AS rate, 5 AS quality, unit, acquisition_us, error_message
    FROM valued WHERE error_message IS NOT NULL""",
)
sql(
    "quality_name",
    "readings",
    "SELECT quality, quality_name AS name, count(*) AS readings FROM readings GROUP BY ALL",
)
sql("status_name", "health", "SELECT status, status_name AS name, count(*) AS updates FROM health GROUP BY ALL")
sql(
    "success_rate",
    "polls",
    """
    SELECT device_id, count(*) AS total, count(*) FILTER (success) AS ok,
           CAST(count(*) FILTER (success) AS DOUBLE) / count(*) * 100 AS success_rate FROM polls GROUP BY device_id""",
)
SCORE = """round(greatest(0.0, (CAST(successful_reads AS DOUBLE) / total_reads
    - least(consecutive_failures * 1e-1, 5e-1)) * 100), 6)"""
sql("health_score", "latest", f"SELECT device_id, {SCORE} AS health_score FROM latest")

# ---------------------------------------------------------------- filters

sql("enabled_channels", "channels", "SELECT device_id, channel, name FROM channels WHERE enabled")
sql("successful_polls", "polls", "SELECT device_id, channel, us, seq FROM polls WHERE success")
sql("drop_unread", "blocks", "SELECT device_id, us, seq, channel, count FROM blocks WHERE count IS NOT NULL")
sql("failed_channels", "blocks", "SELECT device_id, channel, us, seq FROM blocks WHERE count IS NULL")
sql("near_overflow", "blocks", "SELECT device_id, us, seq, channel, count FROM blocks WHERE count > 4200000000")
sql(
    "is_valid_range",
    "decoded",
    """
    SELECT device_id, seq, (min_value IS NULL OR raw_value >= min_value) AND (max_value IS NULL OR raw_value <= max_value)
           AS valid FROM decoded WHERE raw_value IS NOT NULL""",
)
sql(
    "is_valid_range_strict",
    "decoded",
    """
    SELECT device_id, seq, min_value IS NOT NULL AND max_value IS NOT NULL AND raw_value BETWEEN min_value AND max_value
           AS valid FROM decoded WHERE raw_value IS NOT NULL""",
)
sql(
    "is_valid_rate",
    "crated channels",
    """
    SELECT device_id, seq, rate, rate IS NULL OR max_rate_of_change IS NULL OR abs(rate) <= max_rate_of_change AS valid
    FROM crated JOIN channels USING (device_id, channel)""",
)
sql(
    "is_valid_rate_by_name",
    "crated channels",
    """
    SELECT device_id, seq, rate,
           rate IS NULL OR abs(rate) <= CASE WHEN contains(name, 'Temperature') THEN 10 ELSE 1000 END AS valid
    FROM crated JOIN channels USING (device_id, channel)""",
)
sql("good_readings", "readings", f"SELECT {READING_LIST} FROM readings WHERE quality = 0")
sql("high_rate_alerts", "readings", "SELECT device_id, channel, seq, us, rate FROM readings WHERE rate > 10100")
sql("has_tag", "readings", "SELECT device_id, seq, line FROM readings WHERE line IS NOT NULL")


def _slot(us: str, seconds: int) -> str:
    width = seconds * 1000000
    return f"{us} - {us} % {width} AS window_start, {us} - {us} % {width} + {width} AS window_end"


sql("non_empty_batches", "polls", f"SELECT {_slot('us', 5)}, count(*) AS readings FROM polls GROUP BY ALL")

# ---------------------------------------------------------------- grading

sql(
    "grade_quality",
    "crated channels",
    """
    SELECT device_id, channel, us, seq, raw_value, rate,
           CASE WHEN raw_value < min_value OR raw_value > max_value THEN 2
                WHEN abs(rate) > max_rate_of_change THEN 1
                WHEN overflow_check AND raw_value > overflow_threshold THEN 6 ELSE 0 END AS quality
    FROM crated JOIN channels USING (device_id, channel) WHERE enabled""",
)
sql(
    "overflow_threshold",
    "",
    """
    SELECT 'SUP_' || CAST(s_suppkey AS VARCHAR) AS device_id, n AS channel,
           CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 7 = 2 THEN 4294000000 WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 2000000 END
             AS overflow_threshold,
           s_suppkey % 3 <> 1 AND s_suppkey % 7 <> 2 AS overflow_check
    FROM supplier CROSS JOIN (SELECT CAST(unnest(range(2)) AS INTEGER) AS n) WHERE s_suppkey % 23 <> 6""",
)
sql(
    "grade_quality_custom",
    "crated channels",
    """
    SELECT device_id, seq, CASE WHEN raw_value < 0 THEN 2 WHEN contains(name, 'Production') AND raw_value > 1000000 THEN 1
           WHEN abs(rate) > 1000 THEN 1 ELSE 0 END AS quality
    FROM crated JOIN channels USING (device_id, channel)""",
)
sql(
    "validate_value",
    "items supplier_channels",
    """
    SELECT device_id, channel, quality, count(*) AS n, CAST(sum(counter) AS BIGINT) AS total
    FROM (SELECT device_id, channel, counter,
                 CASE WHEN counter < 200000 OR (channel <> 3 AND counter > 9000000) THEN 2
                      WHEN acquisition_us / 1000 > 40 THEN 1
                      WHEN channel <> 5 AND counter > 8000000 THEN 6 ELSE 0 END AS quality
          FROM items JOIN supplier_channels USING (device_id, channel) WHERE success AND enabled)
    GROUP BY ALL""",
)

# ---------------------------------------------------------------- joins

sql(
    "join_channel_config",
    "polls channels",
    "SELECT device_id, channel, seq, name, unit FROM polls JOIN channels USING (device_id, channel) WHERE enabled",
)
sql(
    "join_device_tags",
    "polls devices",
    """
    SELECT device_id, seq, 'line=' || line || ';location=' || location AS device_tags
    FROM polls LEFT JOIN devices USING (device_id)""",
)
sql(
    "join_line",
    "readings lines",
    """
    SELECT r.device_id, r.seq, coalesce(r.line, l.line) AS line
    FROM readings r LEFT JOIN lines l USING (device_id)""",
)
sql(
    "config_as_of",
    "polls",
    """
    SELECT p.device_id, p.seq, v.event_id AS version, CAST(1 + v.event_id % 5 AS DOUBLE) AS scale_factor
    FROM polls p ASOF LEFT JOIN (SELECT *, epoch_us(ts) AS valid_from FROM base WHERE event_type = 'signup') v
      ON p.device_id = v.device_id AND p.us >= v.valid_from""",
)
sql(
    "unread_channels",
    "items supplier_channels",
    """
    SELECT device_id, us, channel FROM (SELECT DISTINCT device_id, us FROM items) JOIN supplier_channels USING (device_id)
    WHERE enabled
    EXCEPT SELECT device_id, us, channel FROM items WHERE success""",
)
sql("known_devices", "polls lines", "SELECT device_id, seq, us FROM polls WHERE device_id IN (SELECT device_id FROM lines)")

# ---------------------------------------------------------------- windows

RATE_LIST = "device_id, channel, us, seq, raw_value, rate"


def _plain_rate(frame: int, wrap: bool) -> str:
    change = "raw_value - o.raw"
    if wrap:
        change = f"CASE WHEN raw_value < o.raw THEN {change} + 4294967295 ELSE {change} END"
    return f"""
    SELECT device_id, channel, us, seq, raw_value, CASE WHEN us > o.us THEN ({change}) / ((us - o.us) / 1e6) END AS rate
    FROM (SELECT *, min(struct_pack(us := us, seq := seq, raw := raw_value))
                    OVER (PARTITION BY device_id, channel ORDER BY us
                          RANGE BETWEEN {frame} PRECEDING AND CURRENT ROW) AS o FROM counters)"""


sql("counter_rate", "crated", f"SELECT {RATE_LIST} FROM crated")
sql("counter_rate_open", "counters", _plain_rate(DAY_US - 1, wrap=False))
sql("counter_rate_plain", "counters", _plain_rate(DAY_US, wrap=False))
sql(
    "rate_gate",
    "decoded",
    f"""
    SELECT device_id, channel, seq, CASE WHEN valid THEN raw_value * 1e0 END AS processed_value,
           CASE WHEN valid AND us > o.us THEN
             (CASE WHEN raw_value < o.raw THEN raw_value - o.raw + 4294967295 ELSE raw_value - o.raw END)
             / ((us - o.us) / 1e6) END AS rate
    FROM (SELECT *, min(CASE WHEN valid THEN struct_pack(us := us, seq := seq, raw := raw_value) END)
                    OVER (PARTITION BY device_id, channel ORDER BY us
                          RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS o
          FROM (SELECT *, raw_value IS NOT NULL AND (min_value IS NULL OR raw_value >= min_value)
                          AND (max_value IS NULL OR raw_value <= max_value) AS valid FROM decoded))""",
)
sql("health_history", "health", f"SELECT {HEALTH_LIST} FROM health")
sql(
    "last_successful_read",
    "health",
    "SELECT device_id, us, seq, is_connected, last_successful_read_us FROM health",
)
sql(
    "health_epochs",
    "log",
    f"""
    , kept AS (
      SELECT *, sum(CASE WHEN kind = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY us, seq) AS epoch
      FROM (SELECT *, coalesce(last_value(CASE WHEN kind IN ('add', 'remove') THEN kind = 'add' END IGNORE NULLS) OVER (
                     PARTITION BY device_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS was
            FROM log)
      WHERE (kind = 'add') <> was),
    counted AS (
      SELECT *, kind IN ('read', 'probe') AS is_read, kind IN ('read', 'probe') AND success AS ok,
             count(*) FILTER (kind IN ('read', 'probe')) OVER w AS total,
             count(*) FILTER (kind IN ('read', 'probe') AND success) OVER w AS oks,
             lag(us, 1, CASE WHEN epoch = 0 THEN {START_US} END) OVER (PARTITION BY device_id, epoch ORDER BY us, seq) AS prev,
             lag(CASE WHEN kind IN ('read', 'probe') AND NOT success THEN error END)
               OVER (PARTITION BY device_id, epoch ORDER BY us, seq) AS prev_error
      FROM kept
      WINDOW w AS (PARTITION BY device_id, epoch ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT device_id, us, seq, kind,
           CASE WHEN ok THEN 0 WHEN is_read THEN 2 WHEN kind = 'remove' THEN 3 ELSE 4 END AS status,
           CASE WHEN ok THEN 'Online' WHEN is_read THEN 'Error' WHEN kind = 'remove' THEN 'Offline' ELSE 'Unknown' END
             AS status_name,
           ok AS is_connected, last_value(CASE WHEN ok THEN us - prev END IGNORE NULLS) OVER w AS last_successful_read_us,
           total - coalesce(max(CASE WHEN ok OR kind IN ('add', 'update') THEN total END) OVER w, 0) AS consecutive_failures,
           CASE WHEN is_read AND NOT ok THEN error WHEN kind = 'remove' THEN prev_error END AS last_error,
           total AS total_reads, oks AS successful_reads,
           CASE WHEN total > 0 THEN CAST(oks AS DOUBLE) / total * 100 ELSE 0 END AS success_rate
    FROM counted
    WINDOW w AS (PARTITION BY device_id, epoch ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
sql(
    "cycle_overrun_shared",
    "items",
    """
    SELECT us, CAST(max(device_us) AS BIGINT) AS cycle_us, count(*) AS devices
    FROM (SELECT us, device_id, sum(acquisition_us) AS device_us FROM items GROUP BY ALL)
    GROUP BY us HAVING max(device_us) > 120000""",
)
sql(
    "cycle_overrun",
    "items",
    """
    SELECT week AS us, CAST(max(device_us) AS BIGINT) AS cycle_us, count(*) AS devices
    FROM (SELECT us // 604800000000 * 604800000000 AS week, device_id, sum(acquisition_us) AS device_us FROM items GROUP BY ALL)
    GROUP BY week HAVING max(device_us) > 600000""",
)
sql(
    "poll_gaps",
    "items",
    """
    SELECT device_id, channel, us, seq, previous_us, us - previous_us AS gap_us
    FROM (SELECT *, lag(us) OVER (PARTITION BY device_id, channel ORDER BY us, seq) AS previous_us FROM items)
    WHERE us - previous_us > 2592000000000""",
)

# ---------------------------------------------------------------- aggregates

sql(
    "service_health",
    "latest",
    """
    SELECT CASE WHEN online = 0 THEN 'Unhealthy' WHEN online < total THEN 'Degraded' ELSE 'Healthy' END AS state,
           CASE WHEN online = 0 THEN 'No devices are online ' WHEN online < total THEN 'Some devices are offline '
                ELSE 'All devices are online ' END || '(' || online || '/' || total || ')' AS description, online, total
    FROM (SELECT count(*) FILTER (status = 0) AS online, count(*) AS total FROM latest)""",
)
sql(
    "device_health_summary",
    "latest",
    f"""
    SELECT device_id, status, is_connected, last_successful_read_us, total_reads, consecutive_failures,
           {SCORE} AS health_score FROM latest""",
)
sql(
    "line_dashboard",
    "readings",
    f"""
    SELECT {_slot('us', 10)}, line, count(*) AS readings,
           arg_max_null(processed_value, struct_pack(us := us, seq := seq)) AS last_value, round(avg(rate), 6) AS avg_rate
    FROM readings WHERE line IS NOT NULL GROUP BY ALL""",
)
sql(
    "line_health",
    "health lines",
    """
    SELECT line, device_id, status, us, updates
    FROM (SELECT line, device_id, status, us, count(*) OVER (PARTITION BY line) AS updates,
                 row_number() OVER (PARTITION BY line ORDER BY us DESC, seq DESC) AS rn
          FROM health JOIN lines USING (device_id)) WHERE rn = 1""",
)
sql(
    "rate_variability",
    "readings",
    f"""
    SELECT * REPLACE (round(cv, 6) AS cv), coalesce(round(cv, 6) > 0.3, false) AS needs_inspection FROM (
      SELECT {_slot('us', 3600)}, device_id, count(*) AS readings,
             stddev_pop(coalesce(rate, 0)) / nullif(avg(coalesce(rate, 0)), 0) AS cv
      FROM readings WHERE quality = 0 GROUP BY ALL)""",
)
sql(
    "throughput_latency",
    "polls",
    f"""
    SELECT {_slot('us', 60)}, count(*) AS readings, round(avg(acquisition_us / 1e3), 6) AS avg_latency_ms
    FROM polls WHERE success GROUP BY ALL""",
)
sql(
    "quality_counts",
    "readings",
    "SELECT device_id, channel, quality, count(*) AS readings FROM readings GROUP BY ALL",
)
sql(
    "duplicate_keys",
    "rule_channels",
    "SELECT device_id, channel, count(*) AS n FROM rule_channels GROUP BY ALL HAVING count(*) > 1",
)
sql(
    "poll_load",
    "load",
    """
    SELECT fleet_id, devices, CAST(enabled_channels AS BIGINT) AS enabled_channels,
           CAST(estimated_cycle_ms AS BIGINT) AS estimated_cycle_ms, estimated_cycle_ms > poll_interval_ms AS too_short
    FROM load""",
)

# ---------------------------------------------------------------- order, limit, sets

sql("order_by_time", "counters", "SELECT * FROM counters ORDER BY us, device_id, channel, seq")
sql("take_n", "counters", "SELECT * FROM counters ORDER BY us, device_id, channel, seq LIMIT 5")
sql("latest_per_device", "latest", f"SELECT {HEALTH_LIST} FROM latest")
sql(
    "health_events",
    "items probes log",
    """
    SELECT device_id, CAST(us AS BIGINT) AS us, kind, count(*) AS events, count(*) FILTER (success) AS ok, max(error) AS error
    FROM (SELECT device_id, us + sum(acquisition_us) OVER (PARTITION BY device_id, us ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS us, 'read' AS kind, success,
                 CASE WHEN NOT success THEN 'read failed' END AS error FROM items
          UNION ALL SELECT device_id, us, kind, success, error FROM probes
          UNION ALL SELECT device_id, us, kind, NULL, NULL FROM log WHERE kind IN ('add', 'remove', 'update'))
    GROUP BY ALL""",
)
sql(
    "all_violations",
    "fleet_own fleet_twice device_own device_twice channel_findings",
    """
    SELECT * FROM fleet_own UNION SELECT * FROM fleet_twice UNION SELECT * FROM device_own
    UNION SELECT * FROM device_twice UNION SELECT * FROM channel_findings""",
)

# ---------------------------------------------------------------- configuration rules

sql("validate_channels", "channel_findings", "SELECT * EXCLUDE (fleet_id) FROM channel_findings")
sql("validate_devices", "device_findings", "SELECT * FROM device_findings")
sql(
    "validate_fleet",
    "fleet_own fleet_twice device_findings",
    """
    SELECT * FROM fleet_own UNION ALL SELECT * FROM fleet_twice UNION ALL
    SELECT * REPLACE ('Device ''' || device_id || ''': ' || message AS message) FROM device_findings""",
)
sql(
    "config_gate",
    "",
    """
    SELECT 'FLEET_' || s_suppkey AS fleet_id, 'SUP_' || s_suppkey AS device_id, '10.1.0.' || (s_suppkey % 250) AS ip_address
    FROM supplier
    WHERE s_suppkey % 23 <> 6 AND s_suppkey % 17 <> 4 AND s_suppkey % 13 <> 5 AND s_suppkey % 19 <> 7
          AND (s_suppkey % 4 = 0 OR s_suppkey % 11 <> 3)""",
)
sql(
    "device_gate",
    "device_findings",
    """
    SELECT device_id, ip_address FROM rule_devices
    WHERE device_id NOT IN (SELECT device_id FROM device_findings)""",
)

# ---------------------------------------------------------------- streams

sql("stream_process", "readings", f"SELECT {READING_LIST} FROM readings")
sql("stream_rate", "crated", f"SELECT {RATE_LIST} FROM crated")
SQL["stream_health"] = SQL["health_epochs"]
SQL["rejected_events"] = f"""
    SELECT device_id, us, seq, '' AS reason
    FROM ({SQL["health_epochs"].replace("FROM log)", "FROM log WHERE seq % 61 <> 4)")})
    UNION ALL SELECT 'DEV_' || CAST(user_id AS VARCHAR), NULL, event_id, 'no_time' FROM events WHERE event_id % 61 = 4"""
sql(
    "rejected_polls",
    "polls",
    """
    SELECT reason, CASE WHEN reason <> 'corrupt_record' THEN seq END AS seq, CASE WHEN reason = '' THEN us END AS us
    FROM (SELECT *, CASE WHEN seq % 41 = 3 THEN 'corrupt_record' WHEN seq % 43 = 7 THEN 'no_device'
                         WHEN seq % 59 = 8 THEN 'no_channel' WHEN seq % 47 = 9 THEN 'no_time' ELSE '' END AS reason
          FROM polls)""",
)
sql("tumbling_buffer", "polls", f"SELECT device_id, seq, {_slot('us', 60)} FROM polls")
sql(
    "tumbling_window",
    "polls",
    f"""
    SELECT {_slot('us', 3600)}, device_id, count(*) AS polls, count(*) FILTER (success) AS ok FROM polls GROUP BY ALL""",
)
sql(
    "sample_latest",
    "polls",
    f"""
    SELECT {_slot('us', 1)}, device_id, channel, us, seq FROM polls
    QUALIFY row_number() OVER (PARTITION BY us // 1000000 ORDER BY us DESC, seq DESC) = 1""",
)
sql(
    "group_stream",
    "counters",
    """
    SELECT device_id, count(*) AS readings, max(us) AS last_us,
           arg_max(raw_value, struct_pack(us := us, seq := seq)) AS last_raw FROM counters GROUP BY device_id""",
)
sql(
    "fan_out",
    "polls",
    """
    SELECT device_id, CAST(count(*) AS BIGINT) AS polls, nullif(count(*) FILTER (NOT success), 0) AS failures
    FROM polls GROUP BY device_id""",
)
# The log arrives ten days at a time, one event in 97 up to two parts late; an hour is closed when it ended an
# hour before the newest event of the parts before.
CTES["arrived"] = f"""
        SELECT *, us // 3600000000 * 3600000000 AS window_us,
               least(2, (us - {START_US}) // 864000000000 + CASE WHEN seq % 97 = 5 THEN 2 ELSE 0 END) AS part FROM polls"""
CTES["judged"] = """
        SELECT a.*, window_us + 3600000000 <= m.mark AS late
        FROM arrived a LEFT JOIN (
          SELECT p.part, max(b.us) - 3600000000 AS mark
          FROM (SELECT DISTINCT part FROM arrived) p JOIN arrived b ON b.part < p.part GROUP BY p.part) m USING (part)"""
NEEDS["arrived"] = ["polls"]
NEEDS["judged"] = ["arrived"]
sql(
    "late_data",
    "judged",
    """
    SELECT window_us AS window_start, window_us + 3600000000 AS window_end, count(*) AS polls FROM judged
    WHERE late IS NOT TRUE AND window_us + 3600000000 <= (SELECT max(us) - 3600000000 FROM judged) GROUP BY window_us""",
)
sql("late_rows", "judged", "SELECT device_id, seq, us FROM judged WHERE late")

# ---------------------------------------------------------------- extension points

sql(
    "custom_validator",
    "custom_graded",
    """
    SELECT device_id, seq, rate, quality, CASE quality WHEN 0 THEN 'Good' WHEN 1 THEN 'Uncertain' WHEN 2 THEN 'Bad'
           ELSE 'ConfigurationError' END AS quality_name FROM custom_graded""",
)
sql(
    "custom_transformer",
    "custom_graded",
    f"SELECT device_id, seq, {TEMPERATURE} AS processed_value, quality FROM custom_graded",
)
sql(
    "custom_processor",
    "decoded",
    """
    SELECT device_id, channel, seq, coalesce(registers[1], 0) AS raw_value, coalesce(registers[1], 0) * 2e0
           AS processed_value, unit FROM decoded""",
)

# ---------------------------------------------------------------- whole pipelines

sql(
    "process_readings",
    "readings tagged",
    f"""
    SELECT {', '.join('r.' + c.strip() for c in READING_LIST.split(','))},
           CASE WHEN r.error_message IS NULL THEN array_to_string(list_sort(t.pairs), ';') ELSE '' END AS tags
    FROM readings r JOIN tagged t USING (device_id, seq)""",
)
sql(
    "read_and_log",
    "brated",
    "SELECT device_id, channel, us, seq, count, rate, count > 4200000000 AS near_overflow FROM brated",
)
OLDEST_IN = """min(CASE WHEN wanted THEN struct_pack(us := us, seq := seq, raw := count) END) OVER (
                  PARTITION BY device_id, channel ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"""
sql(
    "read_and_log_fleet",
    "blocks",
    f"""
    , settings AS (
      SELECT 'DEV_' || CAST(c_custkey AS VARCHAR) AS device_id, c_custkey % 5 = 0 AS two, c_custkey % 3 AS w,
             CASE WHEN c_custkey % 2 = 0 THEN 4200000000 ELSE 4000000000 END AS most, c_custkey % 7 <> 3 AS wanted
      FROM customer)
    SELECT device_id, channel, us, seq, count,
           CASE WHEN wanted AND us > o.us THEN (count - o.raw) / ((us - o.us) / 1e6) END AS rate, count > most AS near_overflow
    FROM (SELECT *, CASE w WHEN 0 THEN {OLDEST_IN.format(21600000000 - 1)} WHEN 1 THEN {OLDEST_IN.format(86400000000 - 1)}
                           ELSE {OLDEST_IN.format(172800000000 - 1)} END AS o
          FROM blocks JOIN settings USING (device_id) WHERE count IS NOT NULL AND (channel < 2 OR NOT two))""",
)
