"""orogen: implicit geological field modelling and corpus preparation on PySpark."""
