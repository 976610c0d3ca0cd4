"""Part of the product-catalogue library."""
