"""Tables, their schema and declared constraints; stores for what is derived from them."""
