"""eventloom: calendar-style event integration and analytics on PySpark."""
