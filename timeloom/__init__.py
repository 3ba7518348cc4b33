"""timeloom: timed-text and interval analytics as DataFrame operators."""
