"""The sample tables mapped to shop tables, and the queries registered over them."""
