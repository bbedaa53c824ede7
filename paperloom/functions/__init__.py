"""Column functions on text, dates, numbers, arrays and JSON. All stay in the JVM unless their name says otherwise."""
