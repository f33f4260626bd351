"""recengine.plans"""
