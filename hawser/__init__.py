"""Analytics over file-transfer activity and account metadata, as DataFrame, SQL and Structured Streaming plans."""
